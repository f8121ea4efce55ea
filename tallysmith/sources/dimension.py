"""The tree of areas and standards, read from YAML, as two small dimension tables."""

from __future__ import annotations

from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TREE = "area string, area_title string, description string, standards array<struct<code: string, text: string>>"


def read_tree(spark: SparkSession, path: str, expected_areas: int | None = 12) -> DataFrame:
    """One row per area with its standards in order; every area needs at least one."""
    with open(path, encoding="utf-8") as handle:
        return tree(spark, yaml.safe_load(handle) or {}, expected_areas)


def tree(spark: SparkSession, raw: dict[str, Any], expected_areas: int | None = 12) -> DataFrame:
    empty = [code for code, entry in raw.items() if not entry.get("standards")]
    if empty:
        raise ValueError(f"areas without standards: {empty}")
    if expected_areas is not None and len(raw) != expected_areas:
        raise ValueError(f"expected {expected_areas} areas, found {len(raw)}: {list(raw)}")
    rows = [
        (
            code,
            (entry.get("title") or code).strip(),
            " ".join((entry.get("description") or "").split()),
            [(s["code"], s["text"].strip()) for s in entry["standards"]],
            ordinal,
        )
        for ordinal, (code, entry) in enumerate(raw.items())
    ]
    return spark.createDataFrame(rows, TREE + ", ordinal int")


def areas(tree_table: DataFrame) -> DataFrame:
    return tree_table.select("area", "area_title", "description", "ordinal", F.size("standards").alias("n_standards"))


def standards(tree_table: DataFrame) -> DataFrame:
    """One row per standard; ``ordinal`` counts through all areas in natural order."""
    spread = tree_table.select("area", F.col("ordinal").alias("area_ordinal"), F.posexplode("standards").alias("place", "s"))
    return spread.select(
        "area", F.col("s.code").alias("standard"), F.col("s.text").alias("standard_text"), "area_ordinal",
        (F.col("area_ordinal").cast("bigint") * 1_000_000_000 + F.col("place")).alias("ordinal"),
    )
