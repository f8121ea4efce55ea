"""Run a query in Spark and in DuckDB and report the first difference."""

from __future__ import annotations

import contextlib
import math
import os
from types import SimpleNamespace

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 10) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(shaped, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def difference(spark_df, con, sql: str) -> str | None:
    left_cols, left = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.sql(sql)
    right_cols, right = rows_of(list(rel.columns), rel.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"first difference in {left_cols}:\n  spark {a}\n  duck  {b}"
    return None


@contextlib.contextmanager
def rows_scanned(spark):
    """Counts the rows that file scans give in the block, from the metrics Spark keeps of each query."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    start, read = store.executionsCount(), SimpleNamespace(rows=0)
    yield read
    bus.waitUntilEmpty(30_000)
    runs = store.executionsList(int(start), int(store.executionsCount() - start))
    for i in range(runs.size()):
        run = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if node.name().startswith("Scan parquet"):
                for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        read.rows += int(values.apply(m.accumulatorId()).replace(",", ""))
