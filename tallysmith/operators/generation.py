"""Filling question quotas from candidate questions, round by round."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysmith.functions.numbers import in_band, round_to
from tallysmith.functions.text import fk_grade, token_set
from tallysmith.operators import quota
from tallysmith.operators.common import checkpointed, number_rows
from tallysmith.operators.quota import SLOT
from tallysmith.operators.similarity import (
    DEFAULT_THRESHOLD, _candidates, _similar, blocking_keys, with_signature,
)

# A provider gets (requests, round) and returns candidates for the requested slots.
Provider = Callable[[DataFrame, int], DataFrame]

# A round looks at this many candidates per slot: a multiple of the need, and at least some.
FRONT_FACTOR, FRONT_LEAST = 8, 64
# And decides no more candidates of an area than this, which bounds the group that is decided in order.
AREA_FRONT = 4_096
# Cells of a plan and places in a reply stay below this, so that positions cannot collide.
PLACES = 100_000_000

ACCEPTED, DUPLICATE, FULL = "accepted", "duplicate", "slot_full"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def accept_candidates(
    candidates: DataFrame, need: DataFrame, existing: DataFrame | None = None, threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """Add ``outcome`` to candidates taken in order of ``position``.

    A candidate of a slot that is already full is passed over, one similar to an accepted question of its
    area is a duplicate, every other one is accepted. ``need`` has one row per open slot; ``existing`` holds
    area, position and question of questions accepted before (with smaller positions).

    Both rules depend on earlier choices, so they are settled together: each round looks at the next few
    candidates of every slot up to the point where no slot can hide an earlier candidate, decides them in
    order, and removes what they rule out from the rest by a join. A round decides at most ``AREA_FRONT``
    candidates of an area.
    """
    # Written first: with a known size Spark broadcasts the slots only while they are small.
    need = checkpointed(need.select(*SLOT, "need"))
    source = candidates.select(*SLOT, "position", token_set("question").alias("tokens"))
    open_slots = need.filter("need > 0").select(*SLOT, "need")
    wanted = source.join(open_slots.drop("need"), SLOT, "left_semi")
    worded = wanted.filter(F.size("tokens") > 0).groupBy(*SLOT, "tokens").agg(F.min("position").alias("position"))
    blank = wanted.filter(F.size("tokens") == 0)
    live = checkpointed(worded.unionByName(blank.select(*worded.columns)))

    known = live.filter(F.size("tokens") > 0).select("area", "position", "tokens")
    if existing is not None:
        old = existing.select("area", "position", token_set("question").alias("tokens")).filter(F.size("tokens") > 0)
        known = known.unionByName(old)
    sets = checkpointed(with_signature(known))
    keys = checkpointed(blocking_keys(sets, threshold))
    live = live.drop("tokens")
    if existing is not None:
        live = _without_similar(live, existing.select("area", "position"), keys, sets, threshold)

    accepted_parts: list[DataFrame] = []
    left = open_slots
    while not live.isEmpty():
        room = F.greatest(F.col("need") * FRONT_FACTOR, F.lit(FRONT_LEAST))
        most = left.agg(F.max(room)).first()[0]
        heads = number_rows(live, SLOT, ["position"], "turn").filter(F.col("turn") <= most).join(left, SLOT)
        heads = checkpointed(heads.filter(F.col("turn") <= room))
        shown = heads.groupBy(*SLOT).agg(F.count("*").alias("shown"), F.max("position").alias("last"))
        size = live.groupBy(*SLOT).agg(F.count("*").alias("size"))
        hidden = shown.join(size, SLOT).filter("size > shown")
        horizon = hidden.groupBy("area").agg(F.min("last").alias("horizon"))
        # Any first part of an area's order can be decided, so a round takes a bounded one.
        places = number_rows(heads.select("area", "position"), ["area"], ["position"], "place")
        ends = places.filter(F.col("place") == AREA_FRONT).select("area", F.col("position").alias("end"))
        safe = heads.join(horizon, "area", "left").join(ends, "area", "left")
        safe = checkpointed(safe.filter("position <= coalesce(least(horizon, end), position)").drop("end"))
        front = keys.join(safe.select("area", "position"), ["area", "position"], "left_semi")
        near = _similar(_candidates(front.filter("lead"), front, threshold), sets, threshold)
        near = near.groupBy("area", F.col("later").alias("position")).agg(F.collect_list("earlier").alias("near"))
        accepted = checkpointed(_in_order(safe.join(near, ["area", "position"], "left")))
        accepted_parts.append(accepted)

        used = accepted.groupBy(*SLOT).agg(F.count("*").alias("used"))
        still = left.join(used, SLOT, "left").withColumn("need", F.col("need") - F.coalesce("used", F.lit(0)))
        left = checkpointed(still.filter("need > 0").select(*SLOT, "need"))
        decided = safe.select(*SLOT, "position")
        undecided = checkpointed(live.join(decided, [*SLOT, "position"], "left_anti").join(left, SLOT, "left_semi"))
        if undecided.isEmpty():
            break
        live = _without_similar(undecided, accepted.select("area", "position"), keys, sets, threshold)

    marks = candidates.join(need.select(*SLOT, F.col("need").alias("_need")), SLOT, "left")
    if not accepted_parts:
        return marks.withColumn("outcome", _outcome(F.lit(False), F.lit(None))).drop("_need")
    accepted = _union(accepted_parts)
    ends = accepted.groupBy(*SLOT).agg(F.count("*").alias("_got"), F.max("position").alias("_end"))
    flags = accepted.select("position", F.lit(True).alias("_accepted"))
    end = F.when(F.col("_got") >= F.col("_need"), F.col("_end"))
    full = marks.join(ends, SLOT, "left").join(flags, "position", "left")
    outcome = _outcome(F.coalesce("_accepted", F.lit(False)), end)
    return full.withColumn("outcome", outcome).select(*candidates.columns, "outcome")


def _in_order(front: DataFrame) -> DataFrame:
    """Slot and position of the accepted candidates of a front; each area is decided in order, in one fold.

    ``front`` has at most ``AREA_FRONT`` rows of an area: slot, need, position, and in ``near`` the positions of the
    earlier candidates that are similar, NULL for none.  A candidate is taken if its slot has room and none of those
    was taken.
    """
    rest = [c for c in SLOT if c != "area"]
    one = F.struct("position", *rest, "need", "near")
    listed = front.select("area", *rest, "position", "need", "near").groupBy("area").agg(F.array_sort(F.collect_list(one)).alias("all"))
    kind = f"array<struct<position: bigint, {', '.join(f'{c}: string' for c in rest)}>>"

    def step(taken: Column, c: Column) -> Column:
        mine = F.filter(taken, lambda t: reduce(Column.__and__, [t[k].eqNullSafe(c[k]) for k in rest]))
        alike = F.coalesce(F.arrays_overlap(c["near"], F.transform(taken, lambda t: t["position"])), F.lit(False))
        fits = (F.size(mine) < c["need"]) & ~alike
        new = F.array(F.struct(c["position"].alias("position"), *[c[k].alias(k) for k in rest])).cast(kind)
        return F.when(fits, F.concat(taken, new)).otherwise(taken)

    folded = listed.select("area", F.explode(F.aggregate("all", F.array().cast(kind), step)).alias("t"))
    return folded.select("area", *[F.col(f"t.{k}").alias(k) for k in rest], "t.position").select(*SLOT, "position")


def _outcome(accepted, end):
    no_room = (F.coalesce("_need", F.lit(0)) <= 0) | (F.col("position") > end)
    return F.when(accepted, ACCEPTED).when(F.coalesce(no_room, F.lit(False)), FULL).otherwise(DUPLICATE)


def _without_similar(live: DataFrame, chosen: DataFrame, keys: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Live candidates that resemble none of the chosen questions."""
    chosen_keys = keys.join(chosen, ["area", "position"], "left_semi")
    live_keys = keys.join(live.select("area", "position"), ["area", "position"], "left_semi")
    pairs = _candidates(chosen_keys, live_keys, threshold)
    ends = _similar(pairs, sets, threshold).select(
        "area", F.explode(F.array("earlier", "later")).alias("position")
    )
    return checkpointed(live.join(ends.distinct(), ["area", "position"], "left_anti"))


@dataclass
class GenerationResult:
    accepted: DataFrame
    rejects: DataFrame
    slots: DataFrame
    rounds: int
    #: Why it ended: "filled", "exhausted" (open slots were stuck and no sibling could take their need) or "rounds".
    stopped: str


def generate(
    plan: DataFrame,
    provider: Provider,
    type_order: Mapping[str, int],
    grade_band: tuple[float, float],
    existing: DataFrame | None = None,
    threshold: float = DEFAULT_THRESHOLD,
    overgen: float = 1.6,
    max_rounds: int = 20,
    patience: int = 2,
    gate: Callable[[DataFrame], DataFrame] | None = None,
) -> GenerationResult:
    """Request candidates for open slots until every quota is met or ``max_rounds`` is reached.

    ``plan``: slot keys, ordinal (of the standard), area_ordinal, target. A provider row holds the slot keys,
    item (its place in the reply), question and answer. Checks run from cheap to expensive: empty text,
    reading grade, then ``gate`` (adds a boolean ``appropriate`` to what is left), then duplicates and need.
    A slot without an accepted candidate in ``patience`` rounds in a row hands its need to its open sibling
    standards.
    """
    spark = plan.sparkSession
    order = F.create_map(*[F.lit(x) for pair in type_order.items() for x in pair])
    cell_order = Window.orderBy("area_ordinal", order[F.col("question_type")], "ordinal")
    have = quota.slot_need(plan, existing) if existing is not None else plan.withColumn("have", F.lit(0).cast("bigint"))
    # One row per slot of the configured plan; the numbering window never sees question rows.
    slots = checkpointed(
        have.select(
            *SLOT, "ordinal", "area_ordinal", "target", "have", F.row_number().over(cell_order).alias("cell"),
            F.lit(False).alias("capped"), F.lit(0).alias("stall"), F.lit(0).cast("bigint").alias("requested"),
        )
    )
    accepted_parts: list[DataFrame] = []
    reject_parts: list[DataFrame] = []
    rounds = 0
    need = F.col("target") - F.col("have")

    def ending() -> str | None:
        if slots.filter((need > 0) & ~F.col("capped")).isEmpty():
            return "filled" if slots.filter(need > 0).isEmpty() else "exhausted"
        return None

    for number in range(1, max_rounds + 1):
        cells = slots.filter((need > 0) & ~F.col("capped")).withColumn("need", need)
        if ending():
            break
        rounds = number
        n_request = F.greatest(F.col("need"), F.rint(F.col("need") * overgen).cast("bigint"))
        requests = cells.withColumn("n_request", n_request)
        replies = provider(requests, number)
        judged = replies.join(cells.select(*SLOT, "cell"), SLOT).withColumns(
            {
                "question": F.trim("question"),
                "answer": F.trim("answer"),
                "round": F.lit(number),
                # Positions grow with the round, the cell and the place in the reply.
                "position": (F.lit(number).cast("bigint") * PLACES + F.col("cell")) * PLACES + F.col("item"),
                "_fits": F.assert_true((F.col("cell") < PLACES) & (F.col("item") < PLACES), "too many cells or items"),
            }
        ).filter("question <> '' AND answer <> '' AND _fits IS NULL").drop("_fits")
        graded = checkpointed(judged.withColumn("grade", fk_grade("question")))
        level = in_band("grade", *grade_band)
        grade_text = F.concat(F.lit("fk_grade="), round_to("grade", 1).cast("string"), F.lit("_out_of_band"))
        readable = graded.filter(level)
        if gate is not None:
            readable = checkpointed(gate(readable))
            unfit = readable.filter(~F.col("appropriate")).withColumn("reason", F.lit("llm_inappropriate"))
            readable = readable.filter("appropriate").drop("appropriate")
        before = _earlier(existing, accepted_parts)
        outcome = checkpointed(
            accept_candidates(readable, cells.select(*SLOT, "need"), before, threshold)
        )
        new = outcome.filter(F.col("outcome") == ACCEPTED)
        accepted_parts.append(
            new.select(*SLOT, "position", "round", "question", "answer", round_to("grade", 2).alias("fk_grade"))
        )
        duplicate = outcome.filter(F.col("outcome") == DUPLICATE).withColumn("reason", F.lit(DUPLICATE))
        columns = [*SLOT, "question", "reason", "round"]
        reject_parts.append(graded.filter(~level).withColumn("reason", grade_text).select(*columns))
        if gate is not None:
            reject_parts.append(unfit.select(*columns))
        reject_parts.append(duplicate.select(*columns))
        slots = checkpointed(_after_round(slots, new, requests, patience))
    if not accepted_parts:
        empty = spark.createDataFrame([], "area string, standard string, question_type string, position bigint, "
                                          "round int, question string, answer string, fk_grade double")
        rejects = empty.select(*SLOT, "question", F.lit("").alias("reason"), "round")
        return GenerationResult(empty, rejects, slots, 0, ending() or "rounds")
    return GenerationResult(_union(accepted_parts), _union(reject_parts), slots, rounds, ending() or "rounds")


def _earlier(existing: DataFrame | None, accepted: list[DataFrame]) -> DataFrame | None:
    parts = [p.select("area", "position", "question") for p in accepted]
    if existing is not None:
        parts.append(existing.select("area", "position", "question"))
    return _union(parts) if parts else None


def _after_round(slots: DataFrame, new: DataFrame, requests: DataFrame, patience: int) -> DataFrame:
    """Book the accepted questions, count idle rounds and redistribute stuck slots."""
    got = new.groupBy(*SLOT).agg(F.count("*").alias("got"))
    asked = requests.select(*SLOT, "n_request")
    state = slots.join(got, SLOT, "left").join(asked, SLOT, "left").withColumns(
        {"got": F.coalesce("got", F.lit(0)), "asked": F.col("n_request").isNotNull()}
    )
    have = F.col("have") + F.col("got")
    idle = F.col("asked") & (F.col("got") == 0) & (F.col("target") - have > 0)
    stall = F.when(idle, F.col("stall") + 1).when(F.col("asked"), 0).otherwise(F.col("stall"))
    state = state.select(
        *SLOT, "ordinal", "area_ordinal", "target", have.alias("have"), "cell", "capped", stall.alias("stall"),
        (F.col("requested") + F.coalesce("n_request", F.lit(0))).alias("requested"),
        (idle & (stall >= patience)).alias("stuck"),
    )
    moved = quota.redistribute(state).select(*SLOT, "target", "capped")
    return state.drop("target", "capped", "stuck").join(moved, SLOT)


def pool_provider(pool: DataFrame) -> Provider:
    """Provider serving stored candidates: slot keys, serial (1, 2, ... per slot), question, answer."""

    def provide(requests: DataFrame, number: int) -> DataFrame:
        window = requests.select(*SLOT, "requested", "n_request")
        served = pool.join(window, SLOT).filter("serial > requested AND serial <= requested + n_request")
        return served.withColumn("item", F.col("serial") - F.col("requested")).drop("serial", "requested", "n_request")

    return provide
