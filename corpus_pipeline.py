"""A corpus in five stages: quality, repeated lines, near copies, benchmark passages, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysmith.llm import catalog, decontam, lines, nearcopies, quality
from tallysmith.operators.common import checkpointed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The quality classifier is fitted on labelled rows and the ids mixed by weights; SQL has no counterpart.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    model = catalog.quality_model(spark, sf_dir)
    return quality.keep_good(docs.select(*COLUMNS), model)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line runs that occurred before."""
    return _sized(lines.dedupe_lines(docs.select(*COLUMNS)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by five-word likenesses of 0.8 or more."""
    return nearcopies.keep_one(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontam.drop_contaminated(docs.select(*COLUMNS), catalog.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document left."""
    return catalog.mixed(spark, docs, sf_dir)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", dedupe_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each reads what the one before it wrote."""
    docs = catalog.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
