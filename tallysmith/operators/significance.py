"""Pairwise McNemar tests between models with Holm correction."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysmith.functions.numbers import round_to, share
from tallysmith.functions.stats import mcnemar
from tallysmith.operators.common import carried, in_ranges, keyed
from tallysmith.operators.ensemble import majority


SIGNIFICANT = "significant_0.05"


#: Up to so many models verdict combinations are counted; with more, nearly every question has one of its own, and
#: verdicts are packed into bits instead.
PATTERN_MODELS = 12
#: Independent numberings of the questions of a group, so that a large group is numbered by several tasks.
SLICES = 16


def _votes(trials: DataFrame, group: Sequence[str]) -> DataFrame:
    if "vote" in trials.columns:  # the table of ``ensemble.votes``
        return trials
    single = [*group, "model", "question_id"]
    return keyed(trials, single[-2:]).groupBy(*single).agg(majority().alias("vote"))


def _per_question(votes: DataFrame, group: Sequence[str]) -> DataFrame:
    return votes.groupBy(*group, "question_id").agg(
        F.array_sort(F.collect_list(F.struct("model", "vote"))).alias("pattern")
    )


def vote_patterns(trials: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """How many complete questions (of each group) show each combination of model verdicts.

    A question is complete when every model answered it. Questions with the same combination are
    counted before any pair is formed, so pairs are made per combination and not per question.
    """
    patterns = _per_question(_votes(trials, group), group).groupBy(*group, "pattern").agg(F.count("*").alias("items"))
    # Counted over the same pattern table, whose shuffle Spark reuses here.
    names = patterns.filter("items > 0").select(F.explode("pattern.model").alias("model"))
    n_models = names.agg(F.count_distinct("model")).scalar()
    return patterns.filter(F.size("pattern") == n_models)


def packed_votes(trials: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Blocks of up to 64 complete questions (of a group): (models, items), a word of verdict bits for each model.

    ``models`` is an array of (model, word) in the order of the models, ``items`` the number of questions.
    """
    votes = _votes(trials, group)
    n_models = votes.agg(F.count_distinct("model")).scalar()
    complete = _per_question(votes, group).filter(F.size("pattern") == n_models)
    cut = [*group, "_slice"]
    numbered = complete.withColumn("_slice", F.pmod(F.xxhash64("question_id"), F.lit(SLICES))).withColumn(
        "_n", F.row_number().over(Window.partitionBy(*cut).orderBy("question_id")) - 1
    )
    block = [*cut, "_block"]
    votes = numbered.select(*cut, F.floor(F.col("_n") / 64).alias("_block"), (F.col("_n") % 64).alias("_bit"), F.explode("pattern").alias("v"))
    bit = F.call_function("shiftleft", (F.col("v.vote") == 1).cast("bigint"), F.col("_bit"))
    words = votes.groupBy(*block, F.col("v.model").alias("model")).agg(F.bit_or(bit).alias("word"), F.count("*").alias("items"))
    return words.groupBy(*block).agg(
        F.array_sort(F.collect_list(F.struct("model", "word"))).alias("models"), F.max("items").alias("items")
    )


def mcnemar_counts(trials: DataFrame, group: Sequence[str] = (), models: int | None = None) -> DataFrame:
    """Per model pair (a before b), in each group: right/wrong counts over complete questions.

    Of few models the combinations of verdicts are counted and pairs formed from each; of many models pairs are formed
    from words of 64 verdicts.  ``models`` saves counting them.
    """
    if models is None:
        models = trials.select("model").distinct().limit(PATTERN_MODELS + 1).count()
    packed = models > PATTERN_MODELS
    table, column = (packed_votes(trials, group), "models") if packed else (vote_patterns(trials, group), "pattern")
    later = F.filter(F.col(column), lambda o: o["model"] > F.col("a.model"))
    pairs = (
        table.select(*group, column, "items", F.explode(column).alias("a"))
        .select(*group, "items", "a", F.explode(later).alias("b"))
    )

    def total(right: Callable[[Column, Column], Column]) -> Column:
        """Questions for which a condition on the verdicts of both holds."""
        if packed:
            return F.sum(F.bit_count(right(F.col("a.word"), F.col("b.word"))))
        return F.sum(F.when(right(F.col("a.vote") == 1, F.col("b.vote") == 1), F.col("items")).otherwise(0))

    def only(x: Column, y: Column) -> Column:
        return x.bitwiseAND(F.bitwise_not(y)) if packed else x & ~y

    return pairs.groupBy(*group, F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b")).agg(
        F.sum("items").alias("n_items"),
        total(lambda a, b: a).alias("correct_a"),
        total(lambda a, b: b).alias("correct_b"),
        total(only).alias("discordant_b"),
        total(lambda a, b: only(b, a)).alias("discordant_c"),
    )


def holm_adjust(tests: DataFrame, p: str, ties: Sequence[str], name: str = "p_holm") -> DataFrame:
    """Step-down Holm adjustment over all tests with a p-value; missing p-values stay missing.

    Tests, model pairs or those of every group, are dealt out by ranges of p.  Each range ranks its own tests; the
    number of tests and the largest product of the ranges before it are carried on.
    """
    order = [F.asc_nulls_last(p), *[F.col(c) for c in ties]]
    ranged = in_ranges(tests, order)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = carried(sizes, F.col("_rows"), lambda a, n: a + n, F.lit(0).cast("bigint"), "_before")
    within = Window.partitionBy("_part").orderBy(*order)
    rank = F.col("_before") + F.row_number().over(within)
    total = ranged.agg(F.count(p)).scalar()
    scored = ranged.join(before, "_part").withColumn("_product", F.col(p) * (total - rank + 1))
    most = scored.groupBy("_part").agg(F.max("_product").alias("_most"))
    larger = carried(most, F.col("_most"), F.greatest, F.lit(None).cast("double"), "_earlier")
    own = F.max("_product").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    adjusted = F.least(F.lit(1.0), F.greatest(own, F.col("_earlier")))
    done = scored.join(larger, "_part").withColumn(name, F.when(F.col(p).isNotNull(), adjusted))
    return done.select(*tests.columns, name)


def significance(trials: DataFrame, alpha: float = 0.05) -> DataFrame:
    """McNemar test for every model pair, Holm-corrected over all pairs."""
    tests = mcnemar_counts(trials).withColumn("p_value", mcnemar("discordant_b", "discordant_c"))
    adjusted = holm_adjust(tests, "p_value", ["model_a", "model_b"])
    return adjusted.select(
        "model_a",
        "model_b",
        round_to(share(F.col("correct_a"), F.col("n_items")), 4).alias("acc_a"),
        round_to(share(F.col("correct_b"), F.col("n_items")), 4).alias("acc_b"),
        (F.col("correct_a") > F.col("correct_b")).cast("int").alias("a_better_b"),
        "discordant_b",
        "discordant_c",
        "p_value",
        "p_holm",
        F.coalesce((F.col("p_holm") < alpha).cast("int"), F.lit(0)).alias(SIGNIFICANT),
    )


def _wins(sig: DataFrame) -> DataFrame:
    a_wins = F.col("a_better_b") == 1
    return sig.filter(F.col(f"`{SIGNIFICANT}`") == 1).select(
        F.when(a_wins, F.col("model_a")).otherwise(F.col("model_b")).alias("winner"),
        F.when(a_wins, F.col("model_b")).otherwise(F.col("model_a")).alias("loser"),
    )


def tested_models(sig: DataFrame) -> DataFrame:
    return sig.select(F.explode(F.array("model_a", "model_b")).alias("model")).distinct()


def win_counts(sig: DataFrame) -> DataFrame:
    """Significant wins per model, models without a win included."""
    wins = _wins(sig).groupBy(F.col("winner").alias("model")).agg(F.count("*").alias("wins"))
    return tested_models(sig).join(wins, "model", "left").select("model", F.coalesce("wins", F.lit(0)).alias("wins"))


def win_matrix(sig: DataFrame, models: Sequence[str]) -> DataFrame:
    """Row model against column model: a tick for a significant win, a dot otherwise, a dash for itself."""
    mark = {m: F.max(F.when(F.col("loser") == m, F.lit(1))) for m in models}
    rows = tested_models(sig).join(_wins(sig), F.col("model") == F.col("winner"), "left").groupBy("model")
    hits = rows.agg(*[mark[m].alias(m) for m in models])
    cells = [
        F.when(F.col("model") == m, "—").when(F.col(m) == 1, "✓").otherwise("·").alias(m) for m in models
    ]
    return hits.select("model", *cells)
