"""Near-duplicate questions by token-set ratio, with an exact distributed greedy pass.

The greedy rule: go through the items in order and drop an item when an already kept one is similar.
Spark evaluates it without comparing every pair and without a sequential task:

* Equal token sets are one item with copies; the first copy stands for all of them.
* Two similar items always share a *key*, see ``blocking_keys``. Items without a common key are never compared.
* Per key only a front of items is settled at a time. Kept items then remove what they resemble from the
  rest, so a large family of near copies shrinks to its first member and is never paired with itself.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysmith.functions.text import token_set
from tallysmith.operators.common import checkpointed, keyed, number_rows

DEFAULT_THRESHOLD = 88.0

#: Leading items of a key that are settled at a time never grow beyond this; the other side of the key may have
#: any number of rows, is only joined to those, and is split by Spark where it is skewed.
FRONT_MOST = 1024


#: Characters of joined tokens, and positions of a text in a word; the two bits left take the carry of an addition.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
WORD = 62
FULL = (1 << WORD) - 1


def letter_masks(text: Column) -> Column:
    """For each word of ``WORD`` characters of a text: for each letter the bits of its places in the word."""
    words = F.sequence(F.lit(0), F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / WORD).cast("int"))

    def places(word: Column, letter: str) -> Column:
        part = F.reverse(F.substring(text, word * WORD + 1, F.lit(WORD)))
        marked = F.translate(part, LETTERS, "".join("1" if x == letter else "0" for x in LETTERS))
        return F.conv(marked, 2, 10).cast("bigint")

    return F.transform(words, lambda word: F.array(*[F.coalesce(places(word, x), F.lit(0)) for x in LETTERS]))


def lcs_length(masks: Column, text: Column) -> Column:
    """Length of the longest common subsequence of a text and that of ``letter_masks``; both of ``LETTERS`` only.

    A row of the usual table of lengths is kept as bits, one for each place where it does not rise, and each letter
    changes all of them by an addition (bit-parallel), word by word with a carry.  ``masks`` should be a column, since
    it is used for every letter.
    """
    letters = F.filter(F.split(text, ""), lambda x: x != "")
    full = F.lit(FULL)

    def merged(row: Column, hit: Column, carry: Column) -> tuple[Column, Column]:
        total = row + hit + carry
        return total.bitwiseAND(full).bitwiseOR(row.bitwiseAND(F.bitwise_not(hit))), F.shiftright(total, WORD)

    def one(row: Column, letter: Column) -> Column:
        hit = row.bitwiseAND(F.get(F.get(masks, F.lit(0)), F.instr(F.lit(LETTERS), letter) - 1))
        return merged(row, hit, F.lit(0).cast("bigint"))[0]

    def many(rows: Column, letter: Column) -> Column:
        def step(state: Column, word: Column) -> Column:
            row = F.get(rows, word)
            hit = row.bitwiseAND(F.get(F.get(masks, word), F.instr(F.lit(LETTERS), letter) - 1))
            new, carry = merged(row, hit, state["carry"])
            return F.struct(F.concat(state["done"], F.array(new)).alias("done"), carry.alias("carry"))

        start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("bigint").alias("carry"))
        return F.aggregate(F.sequence(F.lit(0), F.size(masks) - 1), start, step, lambda s: s["done"])

    short = WORD - F.aggregate(letters, full, one, F.bit_count)
    words = F.transform(masks, lambda _: full)
    flat = lambda rows: F.aggregate(rows, F.lit(0), lambda n, row: n + WORD - F.bit_count(row))
    return F.when(F.size(masks) == 1, short).otherwise(F.aggregate(letters, words, many, flat))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: the same bits as in ``lcs_length``, in one number of any length."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def long_lcs(a: Column, b: Column) -> Column:
    """``common_length`` of two texts, NULL where one is NULL.

    For texts of many words a fold of columns takes time with the words and letters together; one long number is
    some thirty times faster.
    """

    @F.pandas_udf("int")
    def lengths(one: pd.Series, two: pd.Series) -> pd.Series:
        found = [None if x is None or y is None else common_length(x, y) for x, y in zip(one, two)]
        return pd.Series(found, dtype="Int32")

    return lengths(a, b)


def _joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def overlap_parts(a: Column, b: Column) -> Column:
    """Lengths that decide the ratio: common tokens, both differences, and both whole strings."""
    common = F.array_intersect(a, b)
    rest_a, rest_b = F.array_sort(F.array_except(a, b)), F.array_sort(F.array_except(b, a))
    sect = F.length(_joined(common))
    gap = (F.size(common) > 0).cast("int")
    return F.struct(
        F.size(common).alias("n_common"),
        sect.alias("sect"),
        gap.alias("gap"),
        _joined(rest_a).alias("rest_a"),
        _joined(rest_b).alias("rest_b"),
        (sect + gap + F.length(_joined(rest_a))).alias("size_a"),
        (sect + gap + F.length(_joined(rest_b))).alias("size_b"),
        ((F.size(a) == 0) | (F.size(b) == 0)).alias("empty"),
    )


def _score(distance: Column, total: Column) -> Column:
    return F.lit(100.0) - F.lit(100.0) * distance / total


def ratio_without_lcs(p: Column) -> Column:
    """Best ratio that needs no alignment: 0 for an empty side, 100 for a subset, else common part vs side."""
    subset = (F.length(p["rest_a"]) == 0) | (F.length(p["rest_b"]) == 0)
    side_a = _score(p["size_a"] - p["sect"], p["sect"] + p["size_a"])
    side_b = _score(p["size_b"] - p["sect"], p["sect"] + p["size_b"])
    return (
        F.when(p["empty"], 0.0)
        .when(p["n_common"] == 0, 0.0)
        .when(subset, 100.0)
        .otherwise(F.greatest(side_a, side_b))
    )


def letter_counts(tokens: Column) -> Column:
    """How often each letter occurs in a token set."""
    text = _joined(tokens)
    return F.transform(
        F.array(*[F.lit(ch) for ch in "abcdefghijklmnopqrstuvwxyz"]),
        lambda ch: F.length(text) - F.length(F.replace(text, ch, F.lit(""))),
    )


def letter_gap(a: Column, b: Column) -> Column:
    """Lower bound of the edit distance: common tokens cancel, so every surplus letter is an edit."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda acc, n: acc + n)


# Letter counts as bit patterns: eight bits per letter, as many set as the letter occurs, seven letters a word.
SIGNATURE = ["s1", "s2", "s3", "s4"]


def with_signature(sets: DataFrame) -> DataFrame:
    """Add letter counts and their bit patterns to (area, position, tokens)."""

    def word(first: int) -> Column:
        one = F.lit(1).cast("bigint")
        bits = F.lit(0).cast("bigint")
        for slot in range(7):
            if first + slot < 26:
                count = F.least(F.get("letters", F.lit(first + slot)), F.lit(8))
                code = F.call_function("shiftleft", one, count) - one
                bits = bits.bitwiseOR(F.shiftleft(code, 8 * slot))
        return bits

    counted = sets.withColumn("letters", letter_counts(F.col("tokens")))
    return counted.select("*", *[word(7 * i).alias(name) for i, name in enumerate(SIGNATURE)])


def _surplus(a: str, b: str) -> Column:
    """At most the number of letters side ``a`` has beyond those of side ``b``."""
    words = [F.bit_count(F.col(f"{a}.{s}").bitwiseAND(F.bitwise_not(F.col(f"{b}.{s}")))) for s in SIGNATURE]
    return sum(words[1:], words[0])


def token_set_ratio(
    pairs: DataFrame, a: str, b: str, name: str = "ratio", at_least: float | None = None, edits: Column | None = None
) -> DataFrame:
    """Add the 0-100 token-set ratio of two token-set columns.

    With ``at_least`` only rows reaching it are returned, and rows are settled by lengths first, so that only
    undecided ones are aligned. ``edits`` may give a lower bound of the edit distance.
    """
    # The one-row generator keeps Spark from evaluating the parts again inside every filter below.
    parts = pairs.withColumn("_p", F.explode(F.array(overlap_parts(F.col(a), F.col(b)))))
    parts = parts.withColumn("_quick", ratio_without_lcs(F.col("_p")))
    p = F.col("_p")
    total = p["size_a"] + p["size_b"]
    aligned = ~p["empty"] & (F.length(p["rest_a"]) > 0) & (F.length(p["rest_b"]) > 0)
    rest = F.length(p["rest_a"]) + F.length(p["rest_b"])

    def align(rows: DataFrame) -> DataFrame:
        shorter = F.length(p["rest_a"]) <= F.length(p["rest_b"])
        less, more = (F.when(shorter, p[x]).otherwise(p[y]) for x, y in (("rest_a", "rest_b"), ("rest_b", "rest_a")))
        long = F.length(less) > WORD
        # Again a one-row generator, so that the masks are made once for all letters.
        rows = rows.withColumn("_m", F.explode(F.array(F.when(~long, letter_masks(less)))))
        rows = rows.withColumn("_long", long_lcs(F.when(long, less), F.when(long, more)))
        common = F.when(long, F.col("_long")).otherwise(lcs_length(F.col("_m"), more))
        return rows.withColumn(name, F.greatest("_quick", _score(rest - 2 * common, total))).drop("_m", "_long")

    def settle(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, F.col("_quick"))

    if at_least is None:
        done = settle(parts.filter(~aligned)).unionByName(align(parts.filter(aligned)))
        return done.drop("_p", "_quick")
    close = aligned & (F.col("_quick") < at_least)
    fewest = F.abs(p["size_a"] - p["size_b"])
    possible = _score(fewest if edits is None else F.greatest(fewest, edits), total) >= at_least
    sure = settle(parts.filter(F.col("_quick") >= at_least))
    open_ = align(parts.filter(close & possible)).filter(F.col(name) >= at_least)
    return sure.unionByName(open_).drop("_p", "_quick")


def _weight(token: Column) -> Column:
    return F.length(token) + 1


def blocking_keys(sets: DataFrame, threshold: float) -> DataFrame:
    """Keys such that two similar items of an area share one, with at least one of them leading on it.

    ``sets``: area, position, tokens (non-empty, distinct per area) and signature. With d = 1 - threshold / 100:

    * One side nearly inside the other: the tokens of A missing in B weigh (length + 1 each) at most
      2d / (1 + d) of A. So among the rarest tokens of A that weigh more than this, one is in B. These
      tokens lead; all tokens are keys.
    * Two different texts with a small edit distance: one edit changes at most three letter pairs, so the
      bags of letter pairs overlap by a known amount, and the rarest pairs of both bags must meet (prefix
      filter). These keys all lead. For low thresholds single letters take the place of pairs.
    """
    d = 1.0 - threshold / 100.0
    by_rarity = Window.partitionBy("area", "position").orderBy("frequency", "key")
    so_far = by_rarity.rowsBetween(Window.unboundedPreceding, -1)

    tokens = sets.select("area", "position", F.explode("tokens").alias("key"))
    token_count = tokens.groupBy("area", "key").agg(F.count("*").alias("frequency"))
    weighted = tokens.join(token_count, ["area", "key"])
    total = F.sum(_weight(F.col("key"))).over(Window.partitionBy("area", "position"))
    before = F.coalesce(F.sum(_weight(F.col("key"))).over(so_far), F.lit(0))
    token_keys = weighted.select(
        "area",
        "position",
        F.concat(F.lit("t "), "key").alias("key"),
        (before <= (total - 1) * (2 * d / (1 + d))).alias("lead"),
        total.alias("weight"),
        F.lit(False).alias("similar_size"),
    )

    pair_mode = 1 - 3 * d > 0.1
    step = 3 if pair_mode else 1
    bits = sets.select("area", "position", *SIGNATURE)
    padded = F.concat(F.lit(" "), _joined(F.col("tokens")), F.lit(" "))
    cut = F.substring(F.col("padded"), F.col("i"), F.lit(2 if pair_mode else 1))
    grams = (
        sets.select("area", "position", padded.alias("padded"))
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.length("padded") - 1)))
        .select("area", "position", cut.alias("gram"))
        .groupBy("area", "position", "gram")
        .agg(F.count("*").alias("times"))
        .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
        .select("area", "position", F.concat("gram", F.col("nth").cast("string")).alias("key"))
    )
    gram_count = grams.groupBy("area", "key").agg(F.count("*").alias("frequency"))
    bag = F.count("*").over(Window.partitionBy("area", "position"))
    smallest = (bag - 1) * ((1 - d) / (1 + d)) + 1
    needed = F.ceil(((1 - step * d) * (bag + smallest) + 2 * step * d) / 2 - 1e-6)
    place = F.row_number().over(by_rarity)
    gram_keys = (
        grams.join(gram_count, ["area", "key"])
        .select("area", "position", "key", place.alias("place"), bag.alias("weight"), needed.alias("needed"))
        .filter(F.col("place") <= F.col("weight") - F.greatest("needed", F.lit(1)) + 1)
        .select(
            "area", "position", F.concat(F.lit("g "), "key").alias("key"), F.lit(True).alias("lead"), "weight",
            F.lit(True).alias("similar_size"),
        )
    )
    return token_keys.unionByName(gram_keys).join(bits, ["area", "position"])


def _candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Distinct (earlier, later) pairs that share a key on which ``left`` or ``right`` leads.

    Pairs whose letters rule out the ratio are dropped inside the join, by a few bit operations: letter
    pairs stand for a small edit distance, so the surplus letters of both sides are limited; a leading token
    stands for a side that is nearly inside the other, so the surplus of that side is limited.
    """
    d = 1.0 - threshold / 100.0
    a, b = left.alias("a"), right.alias("b")
    same = (F.col("a.area") == F.col("b.area")) & (F.col("a.key") == F.col("b.key"))
    low, high = F.least("a.weight", "b.weight") - 1, F.greatest("a.weight", "b.weight") - 1
    over_a, over_b = _surplus("a", "b"), _surplus("b", "a")
    same_size = (low >= high * ((1 - d) / (1 + d)) - 1e-6) & (over_a + over_b <= (low + high) * d + 1e-6)

    def inside(side: str, over: Column) -> Column:
        return F.col(f"{side}.lead") & (over <= (F.col(f"{side}.weight") - 1) * (2 * d / (1 + d)) + 1e-6)

    near = F.when(F.col("a.similar_size"), same_size).otherwise(inside("a", over_a) | inside("b", over_b))
    leads = F.col("a.lead") | F.col("b.lead")
    different = F.col("a.position") != F.col("b.position")
    return a.join(b, same & near & leads & different).select(
        F.col("a.area").alias("area"),
        F.least("a.position", "b.position").alias("earlier"),
        F.greatest("a.position", "b.position").alias("later"),
    ).distinct()


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose ratio reaches the threshold."""
    sides = {}
    for side, node in (("a", "earlier"), ("b", "later")):
        sides[node] = sets.select(
            "area", F.col("position").alias(node), F.col("tokens").alias(side), F.col("letters").alias(f"{side}_letters")
        )
    full = pairs.join(sides["earlier"], ["area", "earlier"]).join(sides["later"], ["area", "later"])
    edits = letter_gap(F.col("a_letters"), F.col("b_letters"))
    return token_set_ratio(full, "a", "b", at_least=threshold, edits=edits).select("area", "earlier", "later")


def _node(df: DataFrame, name: str) -> DataFrame:
    return df.select("area", F.col("position").alias(name))


def _settle(front: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Greedy choice inside the front: (kept, dropped).

    ``front``: area, position, ready. A ready item without an open earlier neighbour is kept and drops its
    later neighbours; repeated until nothing changes. Only the shrinking edge table is written per step.
    """
    ready = front.filter("ready").select("area", "position")
    kept_parts, dropped_parts = [], []
    while not edges.isEmpty():
        blocked = edges.select("area", F.col("later").alias("position"))
        kept = checkpointed(ready.join(blocked, ["area", "position"], "left_anti"))
        hit = edges.join(_node(kept, "earlier"), ["area", "earlier"], "left_semi")
        dropped = checkpointed(hit.select("area", F.col("later").alias("position")).distinct())
        kept_parts.append(kept)
        gone = kept.unionByName(dropped)
        ready = checkpointed(ready.join(gone, ["area", "position"], "left_anti"))
        if dropped.isEmpty():
            return _union(kept_parts), _union(dropped_parts)
        dropped_parts.append(dropped)
        edges = checkpointed(
            edges.join(_node(dropped, "later"), ["area", "later"], "left_anti")
            .join(_node(gone, "earlier"), ["area", "earlier"], "left_anti")
        )
    return _union([*kept_parts, ready]), _union(dropped_parts)


def _union(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, parts) if parts else None


def _keep_greedily(sets: DataFrame, threshold: float, front_size: int) -> DataFrame | None:
    """Positions kept by the greedy rule among distinct token sets."""
    live = checkpointed(blocking_keys(sets, threshold))
    kept_parts: list[DataFrame] = []
    while not live.isEmpty():
        leading = live.filter("lead").select("area", "key", "position")
        heads = number_rows(leading, ["area", "key"], ["position"], "nth").filter(F.col("nth") <= front_size)
        full = F.count("*") >= front_size
        cuts = heads.groupBy("area", "key").agg(F.when(full, F.max("position")).alias("cut"))
        marked = live.join(cuts, ["area", "key"]).withColumn(
            "inside", F.col("cut").isNull() | (F.col("position") <= F.col("cut"))
        )
        marked = checkpointed(marked)
        inside = marked.filter("inside")
        front = marked.groupBy("area", "position").agg(F.bool_and("inside").alias("ready"))
        edges = _similar(_candidates(inside.filter("lead"), inside, threshold), sets, threshold)
        kept, dropped = _settle(front, checkpointed(edges))
        kept_parts.append(kept)
        gone = kept if dropped is None else kept.unionByName(dropped)
        rest = marked.filter(~F.col("inside"))
        if rest.isEmpty():
            if dropped is None or kept.count() + dropped.count() == front.count():
                break
        else:
            kept_keys = marked.filter(F.col("cut").isNotNull()).join(kept, ["area", "position"], "left_semi")
            beyond = _similar(_candidates(kept_keys, rest, threshold), sets, threshold)
            gone = gone.unionByName(beyond.select("area", F.col("later").alias("position")))
        live = checkpointed(live.join(gone.distinct(), ["area", "position"], "left_anti"))
        front_size = max(front_size, min(front_size * 4, FRONT_MOST))
    return _union(kept_parts)


def greedy_dedupe(
    questions: DataFrame, text: str = "question", area: str | None = "area", position: str = "position",
    threshold: float = DEFAULT_THRESHOLD, front_size: int = 256,
) -> DataFrame:
    """Add ``kept``: 1 unless an earlier kept question of the same area is similar.

    ``position`` is unique and gives the order. Questions without any comparable word are always kept.
    """
    if not 0 < threshold <= 100:
        raise ValueError("threshold must lie in (0, 100]")
    area_value = F.lit("") if area is None else F.coalesce(F.col(area).cast("string"), F.lit(""))
    rows = questions.select(
        area_value.alias("area"), F.col(position).alias("position"), token_set(F.col(text)).alias("tokens")
    )
    blank = rows.filter(F.size("tokens") == 0).select("area", "position")
    first = (
        rows.filter(F.size("tokens") > 0).groupBy("area", "tokens").agg(F.min("position").alias("position"))
    )
    sets = checkpointed(with_signature(first))
    kept = _keep_greedily(sets, threshold, front_size)
    kept = blank if kept is None else kept.unionByName(blank)
    marks = kept.select(F.col("position").alias(position), F.lit(1).alias("kept"))
    return questions.join(marks, position, "left").withColumn("kept", F.coalesce("kept", F.lit(0)))


def token_set_copies(questions: DataFrame, text: str, position: str) -> DataFrame:
    """Questions per area with the same token set: the first one and the number of copies."""
    rows = keyed(questions, ["area"]).withColumn("tokens", _joined(token_set(F.col(text))))
    return rows.groupBy("area", "tokens").agg(
        F.min(position).alias("first_position"), F.count("*").alias("copies")
    ).filter("copies > 1")
