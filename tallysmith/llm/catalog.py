"""One query per text operator, over whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysmith.llm import (
    centroids, decontam, divergence, langid, lines, mixing, neighbours, oracles, quality, simhash, spotsigs, tokens,
    toxicity, warc,
)
from tallysmith.operators.common import checkpointed, scratch_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_toxicity(spark, sf):
    """Toxicity of every document by FTRL weights over its words and word pairs."""
    docs = table(spark, sf, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf, "labels")))


def quality_model(spark: SparkSession, sf: str):
    return quality.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op2_quality(spark, sf):
    """Quality of every document by Naive Bayes support vectors."""
    return quality.classify(table(spark, sf, "documents"), quality_model(spark, sf))


@query
def op3_line_dedup(spark, sf):
    """Lines that stay of every document, as counts and a digest."""
    kept = lines.dedupe_lines(table(spark, sf, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return kept.select(
        "doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("kept_chars"),
        F.sha2(text, 256).alias("kept_sha256"),
    )


@query
def op4_decontamination(spark, sf):
    """Words of every document inside occurrences of benchmark windows."""
    return decontam.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op5_language(spark, sf):
    """Language of every document by the fewest phrases against text of each language."""
    docs = table(spark, sf, "documents")
    return langid.identify(docs, langid.training_texts(docs))


@query
def op6_spot_signatures(spark, sf):
    """Fingerprint of every document, of its edited text, and likeness to that and to the next document."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = spotsigs.with_next(docs, ["text"])
    n = F.length("text")
    cut = F.floor(n / 3)
    pairs = pairs.withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), (n - cut).cast("int")), F.substring("next_text", F.lit(1), cut.cast("int")))
    )
    marked = pairs.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.signatures("text").alias("own"), spotsigs.signatures("edited").alias("other"),
        spotsigs.signatures("next_text").alias("next"),
    )
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", spotsigs.fingerprint("own").alias("fingerprint"),
        spotsigs.fingerprint("other").alias("edited_fingerprint"),
        spotsigs.jaccard("own", "other").alias("near_edited"), spotsigs.jaccard("own", "next").alias("near_next"),
    )


def quality_weights(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, weight): twice the usual weight for documents labelled good, half for bad ones."""
    labels = table(spark, sf, "labels").filter("doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    return labels.select("doc_id", F.when(F.col("q") >= 0.5, 2.0).when(F.col("q") < 0.5, 0.5).alias("weight"))


def mixed(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    rows = docs.select("doc_id", "text", "source")
    sized = rows.select("doc_id", "source", mixing.n_words("text").alias("size"))
    return mixing.mix_sized(sized.join(quality_weights(spark, sf), "doc_id", "left"), quality="weight")


@query
def op7_mixing(spark, sf):
    """Words that the mix takes of every document."""
    return mixed(spark, table(spark, sf, "documents"), sf)


@query
def op8_warc(spark, sf):
    """Every page written to WARC archives and read back."""
    path = f"{scratch_root(spark).rstrip('/')}/{uuid.uuid4().hex}"
    warc.write_archives(warc.planned(table(spark, sf, "pages"), repeats=True), path)
    found = warc.reassembled(warc.read_records(spark, path))
    return warc.resolve(checkpointed(warc.digests(found)))


@query
def op9_token_counts(spark, sf):
    """Tokens of every document before and after three edits: a cut, an insertion and an addition at the end."""
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edits = F.array(
        F.struct(third.alias("start"), F.lit(20).alias("length"), F.lit("").alias("replacement")),
        F.struct((third * 2).alias("start"), F.lit(3).alias("length"), F.lit(" and then, again, ").alias("replacement")),
        F.struct(n.alias("start"), F.lit(0).alias("length"), F.lit("\nThe end.").alias("replacement")),
    )
    return tokens.count_tokens(table(spark, sf, "documents"), edits)


@query
def op10_simhash(spark, sf):
    """SimHash fingerprint and component of every document."""
    return simhash.near_duplicate_groups(table(spark, sf, "documents"))


@query
def op11_neighbours(spark, sf):
    """Ten nearest vectors of every vector whose id is divisible by 100, along Hilbert curves."""
    return neighbours.nearest_rows(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op12_centroids(spark, sf):
    """Cluster of every vector after ten rounds of exact integer k-means."""
    return centroids.described(centroids.cluster_vectors(table(spark, sf, "embeddings")))


@query
def op13_divergence(spark, sf):
    """How the sources of each language differ: from each other, and in their terms from the language."""
    return divergence.audit(table(spark, sf, "documents"))


ORACLES["op3_line_dedup"] = oracles.LINES
ORACLES["op4_decontamination"] = oracles.CONTAMINATION.replace("{docs}", "documents")
ORACLES["op7_mixing"] = oracles.MIX
ORACLES["op12_centroids"] = oracles.clusters()
ORACLES["op13_divergence"] = oracles.DIVERGENCE
