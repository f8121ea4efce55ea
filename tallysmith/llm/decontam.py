"""Benchmark decontamination with a positional inverted index. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallysmith.llm.shared import measured, words
from tallysmith.operators.common import checkpointed

WINDOW = 13
#: Most rows of a term or window table that is broadcast; a larger one is joined by shuffling.
TERM_ROWS = 200_000
DOC_ROWS = 1_000_000
#: Term of the row that closes each document's postings; its position is the document's number of words.
END = ""


def build_index(docs: DataFrame, terms: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Positional postings (doc_key, pos, term, doc_id) of whole texts, written as a table in document order.

    One scan, no shuffle.  With ``terms`` (column term) only their postings are stored; that table is
    broadcast if it is small.  Every row of ``docs`` is a document of its own with a doc_key, so repeated rows
    and NULL keys do no harm, and gets a closing posting with term ``END`` (doc_id is kept there only).
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.array_append(words(text), F.lit(END)).alias("_words"))
    rows = rows.withColumn("doc_key", F.monotonically_increasing_id())
    posted = rows.select("doc_key", "doc_id", F.posexplode("_words").alias("pos", "term"))
    if terms is not None:
        wanted = terms.select("term").union(docs.sparkSession.createDataFrame([(END,)], "term string")).distinct()
        posted = posted.join(measured(wanted, TERM_ROWS)[0], "term", "left_semi")
    doc_id = F.when(F.col("term") == END, F.col("doc_id"))
    return checkpointed(posted.select("doc_key", "pos", "term", doc_id.alias("doc_id")))


def documents(index: DataFrame) -> DataFrame:
    """(doc_key, doc_id, n_words) of every indexed document."""
    return index.filter(F.col("term") == END).select("doc_key", "doc_id", F.col("pos").cast("long").alias("n_words"))


def windows(items: DataFrame, size: int = WINDOW, key: str = "item_id", text: str = "text") -> DataFrame:
    """(phrase, terms, item_id): ``size`` consecutive words of an item; a shorter item is one window.

    An item without words, or with a NULL text, has none.  Equal windows of an item come once.
    """
    rows = items.select(F.col(key).alias("item_id"), words(text).alias("_words")).filter(F.size("_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - size + 1, F.lit(1)))
    cut = rows.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("_words", s, size))).alias("terms"))
    return cut.select(F.array_join("terms", " ").alias("phrase"), "terms", "item_id").distinct()


def _ranked(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, size, rank, offset, term): the terms of each phrase from the rarest of the corpus on.

    A phrase with a term that the index lacks has no occurrence and drops out.
    """
    terms = phrases.select("phrase", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    counts = index.groupBy("term").agg(F.count("*").alias("df"))
    order = Window.partitionBy("phrase").orderBy("df", "offset")
    every = Window.partitionBy("phrase")
    ranked = terms.join(counts, "term").withColumn("_known", F.count("*").over(every))
    ranked = ranked.filter(F.col("_known") == F.col("size")).withColumn("rank", F.row_number().over(order))
    return ranked.select("phrase", "size", "rank", "offset", "term")


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_key, start, size, phrase): every exact occurrence of the phrases (columns phrase, terms).

    The lists of the rarest and second rarest term of a phrase, moved back by their offsets, are intersected;
    what is left probes the postings at its other positions.  Only documents that are left are read again.
    Memory and shuffle follow the occurrences of rare terms and matches, not pairs of anything.
    """
    ranked = checkpointed(_ranked(index, phrases.select("phrase", "terms").distinct()))

    def moved(rank: int) -> DataFrame:
        at = F.col("rank") == F.least(F.lit(rank), F.col("size"))  # a single word is its own second list
        terms, _ = measured(ranked.filter(at).select("term", "phrase", "size", "offset"), TERM_ROWS)
        hits = index.join(terms, "term")
        start = (F.col("pos") - F.col("offset")).alias("start")
        return hits.select("doc_key", start, "phrase", "size").filter("start >= 0")

    seeds = checkpointed(moved(1).join(moved(2).drop("size"), ["doc_key", "start", "phrase"], "left_semi"))
    others = ranked.filter("rank > 2").select("phrase", "offset", F.col("term").alias("wanted"))
    probes = seeds.join(others, "phrase").select(
        "doc_key", "start", "phrase", (F.col("start") + F.col("offset")).alias("pos"), F.col("wanted").alias("term")
    )
    docs, _ = measured(seeds.select("doc_key").distinct(), DOC_ROWS)
    lists = index.select("doc_key", "pos", "term").join(docs, "doc_key", "left_semi")
    met = probes.join(lists, ["doc_key", "pos", "term"], "left_semi")
    met = met.groupBy("doc_key", "start", "phrase").agg(F.count("*").alias("_met"))
    short = seeds.filter("size <= 2")
    long_ = seeds.filter("size > 2").join(met, ["doc_key", "start", "phrase"]).filter(F.col("_met") == F.col("size") - 2)
    return short.unionByName(long_.drop("_met")).select("doc_key", "start", "size", "phrase")


def proximity_matches(index: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    """(doc_key, phrase, pos): occurrences of a phrase's rarest term that have each of its other terms, in any
    order, at most ``span`` words away."""
    ranked = checkpointed(_ranked(index, phrases.select("phrase", "terms").distinct()))
    lead = ranked.filter("rank = 1").select("term", "phrase")
    anchors = checkpointed(index.join(measured(lead, TERM_ROWS)[0], "term").select("doc_key", "pos", "phrase"))
    terms = ranked.join(lead.withColumnRenamed("term", "_lead"), "phrase").filter("term <> _lead")
    terms = terms.select("phrase", "term").distinct()
    needed = terms.groupBy("phrase").agg(F.count("*").alias("_needed"))
    width = max(span, 1)
    cells = F.explode(F.array(*[F.floor(F.col("pos") / width) + d for d in (-1, 0, 1)])).alias("cell")
    probes = anchors.join(terms, "phrase").select("doc_key", "phrase", "pos", "term", cells)
    docs, _ = measured(anchors.select("doc_key").distinct(), DOC_ROWS)
    lists = index.join(docs, "doc_key", "left_semi").select(
        "doc_key", "term", F.col("pos").alias("at"), F.floor(F.col("pos") / width).alias("cell")
    )
    near = probes.join(lists, ["doc_key", "term", "cell"]).filter(F.abs(F.col("at") - F.col("pos")) <= span)
    met = near.select("doc_key", "phrase", "pos", "term").distinct().groupBy("doc_key", "phrase", "pos").agg(
        F.count("*").alias("_met")
    )
    out = anchors.join(needed, "phrase", "left").join(met, ["doc_key", "phrase", "pos"], "left")
    whole = F.coalesce("_met", F.lit(0)) == F.coalesce("_needed", F.lit(0))
    return out.filter(whole).select("doc_key", "phrase", "pos")


def covered_words(matches: DataFrame) -> DataFrame:
    """(doc_key, n_hit): words of a document inside at least one match."""
    order = Window.partitionBy("doc_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = matches.select("doc_key", "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    reached = F.coalesce(F.max("end").over(order), F.lit(0))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", reached))
    return spans.select("doc_key", new.alias("_new")).groupBy("doc_key").agg(F.sum("_new").cast("long").alias("n_hit"))


def contamination(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = 20, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    n_hit counts words inside any occurrence of a window of an item, n_items the items with an occurring
    window; items_sha256 digests their ids, sorted as text and joined by commas (the empty text if none).
    A document is contaminated from one hit per ``share`` words on.  NULL and empty texts have no words;
    an empty ``docs`` gives no rows and empty ``items`` no hits; items with a NULL id count but are not digested.
    """
    cut = checkpointed(windows(items, size))
    index = build_index(docs, cut.select(F.explode("terms").alias("term")).distinct(), key, text)
    matches = checkpointed(phrase_matches(index, cut))
    owners, _ = measured(cut.select("phrase", "item_id"), TERM_ROWS)
    owned = matches.select("doc_key", "phrase").distinct().join(owners, "phrase").select("doc_key", "item_id").distinct()
    ids = F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",")
    per_doc = owned.groupBy("doc_key").agg(F.count("*").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    out = documents(index).join(covered_words(matches), "doc_key", "left").join(per_doc, "doc_key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = 20, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated.

    A verdict follows from the text alone, so it goes back to the rows by a 128-bit key of the text: rows that
    share a key, or have none, are judged each by its own text.
    """
    first, second = (F.xxhash64(F.lit(n), F.col(text)) for n in (0, 1))
    own = docs.withColumn(key, F.struct(first.alias("a"), second.alias("b")))
    bad = contamination(own, items, size, share, key, text).filter("contaminated").select("doc_id.*")
    bad, _ = measured(bad.select(F.col("a").alias("_bad_a"), F.col("b").alias("_bad_b")).distinct(), DOC_ROWS)
    return docs.join(bad, (first == bad["_bad_a"]) & (second == bad["_bad_b"]), "left_anti")
