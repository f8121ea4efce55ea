"""SpotSigs fingerprints and similarity. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysmith.functions.numbers import as_column, bind
from tallysmith.llm.shared import WORD_BREAK, fold_ascii, fresh, measured
from tallysmith.operators.common import checkpointed

CHAIN = 2
SIMILARITY = 0.8
#: Most rows of a block table that is broadcast; a larger one is joined by shuffling.
BLOCK_ROWS = 1_000_000
#: Very common words of four languages, lower case.
ANCHORS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with "
    "au aux avec ce ces dans des du elle en est et il la le les leur ne ou par pas pour que qui sa se son sur un une "
    "auf aus das dem den der des die ein eine einem einen einer für ist mit nicht sich sie sind und von zu zum "
    "al como con de del el en es esta la las lo los más no o para por que se sin su un una y"
)


def signatures(text: Column | str, chain: int = CHAIN, anchors: str = ANCHORS) -> Column:
    """Sorted distinct 64-bit signatures of a text.

    A spot is a content word right after an anchor (a very common word); its signature hashes that anchor and
    the chain of ``chain`` content words from there on, anchors between them left out.  A text without a
    complete chain has one signature, of all its words; NULL counts as the empty text.
    """
    common = sorted(set(anchors.split()))

    def spots(w: Column) -> Column:
        def chains(p: Column) -> Column:
            def one(j: Column) -> Column:
                at = F.element_at(p, j)
                before = F.when(j > 1, F.element_at(p, F.greatest(j - 1, F.lit(1)))).otherwise(F.lit(0))
                parts = [F.element_at(w, at - 1), *[F.element_at(w, F.element_at(p, j + k)) for k in range(chain)]]
                return F.when(at - before > 1, F.xxhash64(*parts))

            return F.filter(F.transform(F.sequence(F.lit(1), F.size(p) - chain + 1), one), lambda s: s.isNotNull())

        content = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: ~F.element_at(w, i).isin(common))
        found = bind(content, lambda p: F.when(F.size(p) >= chain, chains(p)))
        whole = F.array(F.xxhash64(w))
        return bind(found, lambda f: F.when(F.size(f) > 0, F.array_sort(F.array_distinct(f))).otherwise(whole))

    split = F.array_remove(F.split(fold_ascii(F.coalesce(as_column(text), F.lit(""))), WORD_BREAK), "")
    return bind(split, lambda w: F.when(F.size(w) > 0, spots(w)).otherwise(F.array(F.xxhash64(F.lit("")))))


def fingerprint(sigs: Column | str) -> Column:
    """32 hex digits that stand for a set of signatures."""
    sigs = as_column(sigs)
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(sigs)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), sigs)), 16, "0")))


def jaccard(a: Column | str, b: Column | str) -> Column:
    a, b = as_column(a), as_column(b)
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def pruned_jaccard(a: Column, b: Column, least: float) -> Column:
    """Likeness if it is ``least`` or more, else NULL; sets are intersected only where their sizes allow it."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    likeness = jaccard(a, b)
    return F.when(low >= high * F.lit(least), F.when(likeness >= least, likeness))


def similar_sets(docs: DataFrame, least: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, fingerprint) of every row, and pairs (a, b, likeness) of different fingerprints, a < b,
    whose signature sets are at least ``least`` alike.

    Equal sets are one entry, so copies make no pairs.  Sets of size n fall into length classes whose bounds
    grow by 1 / least, so partners are in the same or the next class.  Within a class pair two sets meet only
    under one of their rarest n - ceil(least * n) + 1 signatures, of which similar sets must share one, and only
    where the sizes allow the likeness; then they are compared.
    """
    rows = docs.select(F.col(key).alias("doc_id"), signatures(text).alias("sigs"))
    rows = checkpointed(rows.withColumn("fingerprint", fingerprint("sigs")))
    sets = checkpointed(rows.groupBy("fingerprint").agg(F.first("sigs").alias("sigs")))
    # The size first, so that an exploded row does not carry the whole set.
    each = sets.select("fingerprint", F.size("sigs").alias("n"), "sigs")
    each = each.select("fingerprint", "n", F.explode("sigs").alias("sig"))
    common = each.groupBy("sig").agg(F.count("*").alias("_df"))
    rank = F.row_number().over(Window.partitionBy("fingerprint").orderBy("_df", "sig"))
    needed = F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1
    prefix = each.join(common, "sig").withColumn("_rank", rank).filter(F.col("_rank") <= needed).filter("_df > 1")
    cls = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / least)) + 1e-9)
    prefix = checkpointed(prefix.select("sig", "fingerprint", "n", cls.alias("cls")))
    left = prefix.select("sig", F.col("fingerprint").alias("a"), F.col("n").alias("n_a"), F.col("cls").alias("c"))
    right = prefix.select(
        "sig", F.col("fingerprint").alias("b"), F.col("n").alias("n_b"), F.explode(F.array(F.col("cls"), F.col("cls") - 1, F.col("cls") + 1)).alias("c")
    )
    fits = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(least))
    pairs = left.join(right, ["sig", "c"]).filter(fits).select("a", "b").distinct()
    pairs = pairs.join(sets.select(F.col("fingerprint").alias("a"), F.col("sigs").alias("_a")), "a")
    pairs = pairs.join(sets.select(F.col("fingerprint").alias("b"), F.col("sigs").alias("_b")), "b")
    likeness = pruned_jaccard(F.col("_a"), F.col("_b"), least)
    pairs = pairs.select("a", "b", likeness.alias("likeness")).filter("likeness is not null")
    return rows.select("doc_id", "fingerprint"), pairs


# --- documents against an edited text and their neighbour ---------------------------------------------------

def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", bits: int = 8) -> DataFrame:
    """Adds next_<column>: the values of the row with the next smaller key, cyclically; its own for one row.

    Rows are sorted within blocks of 2**bits keys.  The first row of the block below follows as one extra row;
    which block that is, is found among the blocks, in blocks again, until few are left.  No task sorts more
    than a block.  Repeated keys follow each other in the order of the columns, last first; a NULL key counts
    as the smallest.
    """
    rank = F.coalesce(F.col(key), F.lit(-(1 << 62)))
    block = F.shiftright(rank, bits)
    heads = checkpointed(docs.groupBy(block.alias("_block")).agg(F.max(rank).alias("_head")))
    below = _block_below(heads.select("_block"), bits)
    wanted = below.join(heads.withColumnRenamed("_block", "_below"), "_below").select("_block", "_head")
    wanted, _ = measured(wanted, BLOCK_ROWS)
    # Everything else travels in two structs, so names cannot clash.
    rest = [c for c in docs.columns if c not in columns]
    every = F.struct(*rest, F.lit(True).alias(fresh(docs, "_"))).alias("_rest")
    rows = docs.select(rank.alias("_k"), block.alias("_block"), every, F.struct(*columns).alias("_row"))
    first = rows.select("_k", "_row").join(wanted, F.col("_k") == F.col("_head"))
    extra = first.groupBy("_block").agg(F.max("_row").alias("_row"))
    rows = rows.unionByName(extra, allowMissingColumns=True)
    order = Window.partitionBy("_block").orderBy(F.col("_k").desc_nulls_last(), F.col("_row").desc())
    found = rows.withColumn("_next", F.lead("_row").over(order)).filter("_k is not null")
    return found.select(
        *[F.col("_rest")[c].alias(c) for c in rest], *[F.col("_row")[c].alias(c) for c in columns],
        *[F.col("_next")[c].alias(f"next_{c}") for c in columns],
    )


def _block_below(blocks: DataFrame, bits: int, few: int = 4096) -> DataFrame:
    """(_block, _below): for each block the next smaller one of the table; the largest for the smallest."""
    if blocks.count() <= few:
        order = Window.orderBy(F.col("_block").desc())
        top = F.max("_block").over(Window.partitionBy())
        return blocks.select("_block", F.coalesce(F.lead("_block").over(order), top).alias("_below"))
    upper = blocks.withColumn("_up", F.shiftright("_block", bits))
    inside = Window.partitionBy("_up").orderBy(F.col("_block").desc())
    upper = upper.withColumn("_next", F.lead("_block").over(inside))
    tops = checkpointed(blocks.groupBy(F.shiftright("_block", bits).alias("_up")).agg(F.max("_block").alias("_top")))
    below = _block_below(tops.select(F.col("_up").alias("_block")), bits, few)
    tops = below.join(tops.select(F.col("_up").alias("_below"), "_top"), "_below")
    tops = tops.select(F.col("_block").alias("_up"), "_top")
    return upper.join(tops, "_up", "left").select("_block", F.coalesce("_next", "_top").alias("_below"))
