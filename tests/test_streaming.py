import pytest
from pyspark.sql import functions as F

from compare import rows_scanned
from tallysmith.sources import tables
from tallysmith.sources.schemas import _table, I, S
from tallysmith.streaming.live import follow_totals, latest_totals
from tallysmith.streaming.resume import KeyedTable, follow

SCHEMA = _table(question_id=S, run=I, text=S)


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["question_id", "run"], SCHEMA)
    assert table.read().count() == 0
    rows = spark.createDataFrame([("Q1", 1, "a"), ("Q1", 1, "b"), ("Q1", 2, "c")], SCHEMA)
    table.append(rows)
    table.append(rows)
    assert sorted(tuple(r) for r in table.read().collect()) == [("Q1", 1, "a"), ("Q1", 2, "c")]
    tasks = spark.createDataFrame([("Q1", "1"), ("Q2", "1")], "question_id string, run string")
    assert [r.question_id for r in table.pending(tasks).collect()] == ["Q2"]
    again = KeyedTable(spark, str(tmp_path / "t"), ["question_id", "run"], SCHEMA, fresh=True)
    assert again.read().count() == 0 and (tmp_path / "kept" / "t").exists()


def test_follow_appends_each_key_once(spark, tmp_path):
    source, table = str(tmp_path / "in"), KeyedTable(spark, str(tmp_path / "out"), ["question_id", "run"], SCHEMA)
    first = spark.range(20).select(F.concat(F.lit("Q"), "id").alias("question_id"), F.lit(1).alias("run"), F.lit("x").alias("text"))
    first.write.parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    follow(stream(), table, str(tmp_path / "cp"))
    assert table.read().count() == 20
    spark.range(10, 30).select(
        F.concat(F.lit("Q"), "id").alias("question_id"), F.lit(1).alias("run"), F.lit("y").alias("text")
    ).write.mode("append").parquet(source)
    follow(stream(), table, str(tmp_path / "cp"))
    rows = table.read().collect()
    assert len(rows) == 30 and sum(r.text == "y" for r in rows) == 10
    assert follow(stream(), table, str(tmp_path / "cp")) == 0


def tasks_of(spark, n):
    return spark.range(n).select(F.concat(F.lit("Q"), "id").alias("question_id"), F.lit(1).alias("run"), F.lit("why").alias("prompt"))


def answered(part):
    return part.withColumn("text", F.concat("question_id", F.lit("!")))


@pytest.mark.parametrize("size, parts", [(400, 2), (50, 16), (1000, 1)])
def test_filling_reads_every_task_once(spark, tmp_path, size, parts):
    """However many parts: tasks are read once by the comparison and once by their part, and the table not again."""
    source = str(tmp_path / "tasks")
    tasks_of(spark, 800).write.parquet(source)
    table = KeyedTable(spark, str(tmp_path / "t"), ["question_id", "run"], SCHEMA)
    with rows_scanned(spark) as read:
        assert table.fill(spark.read.parquet(source), answered, size) == parts
    assert table.read().count() == 800
    # The source, the open tasks and the dealt tasks; counting reads no columns but counts rows.
    assert 800 * 2 <= read.rows <= 800 * 4, read.rows
    with rows_scanned(spark) as read:
        assert table.fill(spark.read.parquet(source), answered, size) == 0
    assert read.rows <= 800 * 3


def test_filling_goes_on_after_a_failure(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["question_id", "run"], SCHEMA)
    calls = []

    def failing(part):
        calls.append(part.count())
        if len(calls) == 3:
            raise RuntimeError("lost")
        return answered(part)

    with pytest.raises(RuntimeError):
        table.fill(tasks_of(spark, 100), failing, 20)
    assert table.read().count() == sum(calls[:2])
    asked = []
    table.fill(tasks_of(spark, 100), lambda part: answered(part).withColumn("n", F.lit(asked.append(part.count()))), 20)
    assert sum(asked) == 100 - sum(calls[:2]) and table.read().count() == 100
    assert table.fill(tasks_of(spark, 100).union(tasks_of(spark, 100)), failing, 20) == 0


def test_small_files_are_merged(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["question_id", "run"], SCHEMA)
    table.fill(tasks_of(spark, 60), answered, 10)
    before = sorted(map(tuple, table.read().collect()))
    files, _ = tables.data_files(spark, table.path)
    assert files >= 6 and not table.compact(files) and table.compact(files - 1)
    assert tables.data_files(spark, table.path)[0] == 1
    assert sorted(map(tuple, table.read().collect())) == before


def test_a_broken_replacement_is_finished(spark, tmp_path):
    """After a crash between the two moves the new rows are there, and a table half written is not used."""
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    spark.range(5).write.parquet(path + tables.WAITING)
    (tmp_path / "t-next" / "_SUCCESS").rename(tmp_path / "t-next" / "_other")
    tables.backup(spark, path)
    tables.recover(spark, path)
    assert not tables.exists(spark, path)
    (tmp_path / "t-next" / "_other").rename(tmp_path / "t-next" / "_SUCCESS")
    tables.recover(spark, path)
    assert spark.read.parquet(path).count() == 5
    tables.replace(spark.read.parquet(path).filter("id < 2"), path)
    assert spark.read.parquet(path).count() == 2 and not tables.exists(spark, path + tables.WAITING)


def test_totals_follow_appends_and_survive_a_replay(spark, tmp_path):
    """Only new rows are read; a batch whose commit was lost is written again, not added."""
    source, totals, state = (str(tmp_path / n) for n in ("in", "totals", "state"))
    schema = _table(model=S, run=I)
    names = _table(model=S).add("rows", "long").add("run", "long")

    def look():
        batches = follow_totals(spark.readStream.schema(schema).parquet(source), ["model"], ["run"], totals, state)
        return batches, sorted(map(tuple, latest_totals(spark, ["model"], totals, names).collect()))

    assert latest_totals(spark, ["model"], totals, names).count() == 0
    spark.createDataFrame([("a", 1), ("b", 5)], schema).write.parquet(source)
    assert look() == (1, [("a", 1, 1), ("b", 1, 5)])
    spark.createDataFrame([("a", 2), ("a", None)], schema).write.mode("append").parquet(source)
    assert look() == (1, [("a", 3, 3), ("b", 1, 5)])
    assert look() == (0, [("a", 3, 3), ("b", 1, 5)])
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].rename(tmp_path / "lost")
    (tmp_path / "state" / "commits" / f".{commits[-1].name}.crc").rename(tmp_path / "lost.crc")
    assert look()[1] == [("a", 3, 3), ("b", 1, 5)]
