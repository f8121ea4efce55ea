import random

import pytest
from pyspark.sql import functions as F

from brute import accept, dedupe, ratio, tokens
from tallysmith.functions.text import token_set
from tallysmith.operators import generation, similarity
from tallysmith.operators.common import number_rows

WORDS = ("neutron neutrons proton electron football foot ball energy transfer transfers heat light lights cells cell "
         "gene what is a the").split()


def questions(seed, count, longest=6):
    rng = random.Random(seed)
    return [
        (i, rng.choice("AB"), " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, longest)))) for i in range(count)
    ]


def test_three_questions(spark):
    rows = [(0, "x", "What is a neutron?"), (1, "x", "what is a neutron"), (2, "x", "How do plants make food?")]
    df = spark.createDataFrame(rows, "position long, area string, question string")
    got = {r.position: r.kept for r in similarity.greedy_dedupe(df).collect()}
    assert got == {0: 1, 1: 0, 2: 1}


def test_ratio(spark):
    texts = [t for _, _, t in questions(1, 40)] + ["étoile naïve", "a the", "x" * 70, "x" * 69 + "y"]
    rows = [(a, b) for a in texts for b in texts[:12]]
    df = spark.createDataFrame(rows, "x string, y string").select("x", "y", token_set("x").alias("a"), token_set("y").alias("b"))
    for row in similarity.token_set_ratio(df, "a", "b").collect():
        assert row.ratio == pytest.approx(ratio(tokens(row.x), tokens(row.y))), row
    close = {(r.x, r.y) for r in similarity.token_set_ratio(df, "a", "b", at_least=80.0).collect()}
    assert close == {(x, y) for x, y in rows if ratio(tokens(x), tokens(y)) >= 80.0}


@pytest.mark.parametrize("threshold, front, seed", [(88.0, 1000, 5), (88.0, 2, 6), (70.0, 3, 7), (100.0, 2, 8)])
def test_greedy_dedupe(spark, threshold, front, seed):
    rows = questions(seed, 90)
    df = spark.createDataFrame(rows, "position long, area string, question string")
    got = {r.position: r.kept for r in similarity.greedy_dedupe(df, threshold=threshold, front_size=front).collect()}
    assert got == dedupe(rows, threshold)


def test_family_of_near_copies_is_not_paired(spark):
    """A third of the rows are variants of one text; they fall to its first member."""
    rows = [(i, "A", f"the quick brown fox jumps over lazy sleeping dogs number {i}") for i in range(60)]
    rows += [(100 + i, "A", f"{w} {w[::-1]} {w * 2}") for i, w in enumerate(["mitosis", "gravity", "plasma"])]
    df = spark.createDataFrame(rows, "position long, area string, question string")
    got = {r.position: r.kept for r in similarity.greedy_dedupe(df, front_size=2).collect()}
    assert got == dedupe(rows, 88.0) and sum(got.values()) == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_accept(spark, seed):
    rng = random.Random(seed)
    rows = [(i + 100, a, rng.choice("st"), rng.choice(["r", "c"]), q) for i, a, q in questions(seed + 20, 80, 4)]
    need = {(a, s, t): rng.randint(0, 5) for a in "AB" for s in "st" for t in ("r", "c")}
    old = [(1, "A", "gene cell energy"), (2, "B", "heat light proton")]
    slot = "area string, standard string, question_type string"
    candidates = spark.createDataFrame(rows, f"position long, {slot}, question string")
    wanted = spark.createDataFrame([(*k, n) for k, n in need.items()], f"{slot}, need long")
    existing = spark.createDataFrame(old, "position long, area string, question string")
    got = generation.accept_candidates(candidates, wanted, existing)
    assert {r.position: r.outcome for r in got.collect()} == accept(rows, need, 88.0, [(a, q) for _, a, q in old])


def test_generation_rounds_redistribute(spark):
    """Standard s1 offers one distinct question only; its sibling takes over what is missing."""
    slot = "area string, standard string, question_type string"
    plan = spark.createDataFrame(
        [("A", "s1", "r", 0, 0, 3), ("A", "s2", "r", 1, 0, 3)], f"{slot}, ordinal int, area_ordinal int, target long"
    )
    good = ["mitosis divides", "gravity pulls", "plasma glows", "enzymes digest", "volcano erupts", "comet orbits", "tide rises"]
    pool = [("A", "s1", "r", i + 1, "same question always", "yes") for i in range(40)]
    pool += [("A", "s2", "r", i + 1, q, "yes") for i, q in enumerate(good)]
    pool_df = spark.createDataFrame(pool, f"{slot}, serial long, question string, answer string")
    result = generation.generate(
        plan, generation.pool_provider(pool_df), {"r": 0}, (-99.0, 99.0), max_rounds=6, patience=2,
        gate=lambda df: df.withColumn("appropriate", F.col("question") != "plasma glows"),
    )
    accepted = result.accepted.collect()
    assert sorted(r.question for r in accepted if r.standard == "s1") == ["same question always"]
    assert len([r for r in accepted if r.standard == "s2"]) == 5
    reasons = {r.reason for r in result.rejects.collect()}
    assert reasons == {"duplicate", "llm_inappropriate"}
    slots = {r.standard: (r.target, r.have, r.capped) for r in result.slots.collect()}
    assert slots == {"s1": (1, 1, True), "s2": (5, 5, False)}


def test_a_word_in_a_third_of_the_rows(spark):
    """A common word without near copies: the front stays bounded and nothing is dropped wrongly."""
    rng = random.Random(11)
    letters = "bcdfghjklmnpqrstvwz"
    word = lambda: "".join(rng.choice(letters) for _ in range(7))
    rows = [(i, "A", f"{'energy ' if i % 3 == 0 else ''}{word()} {word()} {word()}") for i in range(300)]
    rows += [(1000 + i, "A", rows[i][2]) for i in range(0, 300, 50)]
    df = spark.createDataFrame(rows, "position long, area string, question string")
    got = {r.position: r.kept for r in similarity.greedy_dedupe(df, front_size=8).collect()}
    assert got == dedupe(rows, 88.0) and sum(got.values()) == 300


@pytest.mark.parametrize("hot, width", [(1 << 20, 1 << 20), (3, 4), (0, 1)])
def test_every_row_is_numbered(spark, hot, width):
    rng = random.Random(hot + width)
    rows = [(rng.choice("abc") if i % 3 else "hot", rng.randint(-20, 60), i) for i in range(200)] + [(None, 5, 900), (None, 1, 901)]
    df = spark.createDataFrame(rows, "k string, a long, b long")
    got = {r.b: r.n for r in number_rows(df, ["k"], ["a", "b"], "n", hot, width).collect()}
    want = {}
    for k in ("a", "b", "c", "hot"):
        for n, (_, _, b) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]), 1):
            want[b] = n
    assert {b: n for b, n in got.items() if b < 900} == want and len(got) == len(rows)


def test_long_alignments_as_one_number(spark):
    """Long sides are aligned outside the column fold, with the lengths of the usual table; NULL stays NULL."""
    rng = random.Random(5)
    rows = [("".join(rng.choice("abc 1") for _ in range(rng.randint(1, 400))), "".join(rng.choice("abc 1") for _ in range(rng.randint(1, 400)))) for _ in range(12)]

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    df = spark.createDataFrame([*rows, (None, "a")], "a string, b string")
    got = df.select("a", "b", similarity.long_lcs(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == (None if r.a is None else table(r.a, r.b)) for r in got)
    sets = spark.createDataFrame([([a], [b]) for a, b in rows], "a array<string>, b array<string>")
    plan = similarity.token_set_ratio(sets, "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
