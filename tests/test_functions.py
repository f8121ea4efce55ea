"""Single expressions against known values."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallysmith.functions import numbers as N
from tallysmith.functions import replies as R
from tallysmith.functions import stats as S
from tallysmith.functions import text as T
from tallysmith.operators import significance


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_wilson(spark):
    low, high = S.wilson_bounds(F.lit(1099), F.lit(1119))
    assert one(spark, N.round_to(low, 4), N.round_to(high, 4)) == (0.9726, 0.9884)
    low, high = S.wilson_bounds(F.lit(0), F.lit(0))
    assert one(spark, low, high) == (None, None)


@pytest.mark.parametrize("x", [0.0, 1e-3, 0.3, 1.0, 1.9999, 2.0, 2.5, 5.0, 9.0, 20.0])
def test_erfc(spark, x):
    assert one(spark, S.erfc(F.lit(x))) == pytest.approx(math.erfc(x), rel=1e-11)


def test_mcnemar(spark):
    p = lambda b, c: one(spark, S.mcnemar(F.lit(b), F.lit(c)))
    assert p(3, 173) == pytest.approx(3.596e-37, rel=1e-3)
    assert p(2, 7) == 0.1796875
    assert p(40, 41) == 1.0
    assert p(0, 0) == 1.0
    assert p(12, 12) == 1.0
    for b in range(25):
        for c in range(25 - b):
            n, k = b + c, min(b, c)
            exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
            if (b + 3 * c) % 5 == 0:
                assert p(b, c) == pytest.approx(exact, rel=1e-12)


def test_holm_with_ties_and_missing(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.04), ("d", None), ("e", 0.5)], "k string, p double")
    got = {r["k"]: r["h"] for r in significance.holm_adjust(tests, "p", ["k"], "h").collect()}
    assert got["a"] == pytest.approx(0.04) and got["b"] == pytest.approx(0.12) == pytest.approx(got["c"])
    assert got["d"] is None and got["e"] == 0.5


def plain_holm(rows):
    """(key, p) to adjusted p, ties in the order of the keys."""
    known = sorted((p, k) for k, p in rows if p is not None)
    out, most = {k: None for k, _ in rows}, 0.0
    for i, (p, k) in enumerate(known):
        most = max(most, p * (len(known) - i))
        out[k] = min(1.0, most)
    return out


@pytest.mark.parametrize("n, missing", [(0, 0), (1, 0), (5, 5), (400, 30)])
def test_holm_over_many_ranges(spark, n, missing):
    rng = random.Random(n)
    rows = [(i, rng.choice([0.0, 1.0, round(rng.random() ** 4, 3)])) for i in range(n)] + [(1000 + i, None) for i in range(missing)]
    tests = spark.createDataFrame(rows, "k long, p double").repartition(3)
    adjusted = significance.holm_adjust(tests, "p", ["k"], "h")
    got = {r["k"]: r["h"] for r in adjusted.collect()}
    want = plain_holm(rows)
    assert set(got) == set(want) and all(got[k] == want[k] if want[k] is None else got[k] == pytest.approx(want[k]) for k in want)
    plan = adjusted._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Window \[[^\n]*\], \[[^\]]*ASC", plan) or "_part" in plan
    assert all("_part" in line for line in plan.splitlines() if re.search(r"\bWindow \[", line))


def test_packed_votes_of_many_models(spark):
    """Sixty models: pairs from words of 64 verdicts equal pairs from verdict combinations and plain counts."""
    rng = random.Random(1)
    rows = [(f"m{m:02d}", q, f"g{q % 3}", int(rng.random() < 0.3 + m / 120)) for m in range(60) for q in range(150) if (m, q % 40) != (7, 3)]
    votes = spark.createDataFrame(rows, "model string, question_id long, g string, vote int").repartition(4)
    for group in ([], ["g"]):
        wide = significance.mcnemar_counts(votes, group)
        assert "bit_or" in wide._jdf.queryExecution().optimizedPlan().toString()
        by_pattern = significance.mcnemar_counts(votes, group, models=1)
        assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, by_pattern.collect()))
    said = {}
    for m, q, _, v in rows:
        said.setdefault(q, {})[m] = v
    whole = [v for v in said.values() if len(v) == 60]
    r = significance.mcnemar_counts(votes).filter("model_a = 'm03' AND model_b = 'm50'").first()
    assert (r.n_items, r.correct_a, r.discordant_b) == (
        len(whole), sum(v["m03"] for v in whole), sum(v["m03"] > v["m50"] for v in whole))
    assert r.discordant_c == sum(v["m03"] < v["m50"] for v in whole)


def test_kappas(spark):
    k = lambda *n: one(spark, S.cohen_kappa(*[F.lit(v) for v in n]))
    assert k(2, 0, 0, 2) == 1.0
    assert k(0, 0, 0, 5) == 1.0
    assert k(1, 1, 1, 1) == 0.0
    assert k(0, 0, 0, 0) is None
    f = lambda mean, ones, n, r: one(spark, S.fleiss_kappa(F.lit(mean), F.lit(ones), F.lit(n), F.lit(r)))
    assert f(1.0, 9, 3, 3) == 1.0
    assert f((1 + 1 + 1 / 3) / 3, 5, 3, 3) == pytest.approx(0.55)
    assert f(1.0, 0, 0, 3) is None and f(1.0, 1, 1, 1) is None


def test_rounding_and_coercion(spark):
    assert one(spark, N.round_to(F.lit(0.0625), 3)) == 0.062
    assert one(spark, N.round_to(F.lit(0.1875), 3)) == 0.188
    assert one(spark, *[N.to_number(F.lit(v)) for v in ("1.0", "x", "NaN", " 2 ")]) == (1.0, None, None, 2.0)
    assert one(spark, *[N.to_flag(F.lit(v)) for v in ("1", "1.0", "", "yes")]) == (1, 1, 0, 0)
    assert one(spark, *[N.truthy(F.lit(v)) for v in ("True", " YES", "1.0", "0", None)]) == (True, True, True, False, False)
    assert one(spark, *[N.band_distance(F.lit(v), 5.0, 9.0) for v in (4.5, 5.0, 9.0, 10.0)]) == (0.5, 0.0, 0.0, 1.0)


def test_refusals(spark):
    cases = {"I can't help": 1, "As an AI model": 1, " ": 1, "\n\t": 1, "Ice can't melt": 0, "i cannot": 1, "I wont do it": 1,
             "I am unable to say": 1, "I can help": 0, "Sorry, I can't": 0, "  I cant": 1}
    got = one(spark, *[T.is_refusal(F.lit(c), F.lit(0)).cast("int") for c in cases])
    assert dict(zip(cases, got)) == cases
    assert one(spark, T.is_refusal(F.lit(None).cast("string"), F.lit(0)), T.is_refusal(F.lit("fine"), F.lit(1))) == (True, True)


def test_text(spark):
    assert one(spark, T.normalize(F.lit("What is a Neutron-star, in 2 words?"))) == "neutron star 2 words"
    counts = one(spark, T.readability_counts(F.lit("The simple cat sat here. Dogs like the big table! No.")))
    assert counts.asDict() == {"words": 11, "sentences": 2, "syllables": 13}
    assert one(spark, T.fk_grade(F.lit("  ")), T.reading_ease(F.lit(""))) == (0.0, 0.0)
    filled = T.fill_template("$a ${b}c $$x $missing", a=F.lit(1), b=F.lit("B"))
    assert one(spark, filled) == "1 Bc $x $missing"
    assert one(spark, *[T.reject_bucket(F.lit(r)) for r in ("fk_grade=1", "duplicate", "else")]) == (
        "reading grade", "like another question", "else")
    assert one(spark, T.percent_label(F.lit(97.4)), T.percent_label(F.lit(None).cast("double"))) == ("97%", "n/a")
    assert one(spark, T.collapse_space(F.lit(" a \n b "))) == "a b"


@pytest.mark.parametrize(
    "reply, score, is_object",
    [
        ('{"score": 1}', 1, True), ('{"score": "1"}', 1, True), ('{"score": true}', 1, True), ('{"score": 1.0}', 1, True),
        ('{"score": "true"}', 0, True), ('{"score": "1.0"}', 0, True), ('{"score": 2}', 0, True), ("[1]", 0, False),
        ('```json\n{"score": 1}\n```', 1, True), ('```\n{"score": 1}\n``` bye', 1, True),
        ('Here: {"score": 1} ok', 1, True), ("nonsense", 0, False), ("", 0, False), ('{"score": 1', 0, False),
        ('{"score": 0}', 0, True), ('"text"', 0, False), ('[{"score": 1}]', 1, True),
    ],
)
def test_replies(spark, reply, score, is_object):
    obj = R.parse_reply(F.lit(reply))
    assert one(spark, R.binary_verdict(obj, "score"), obj.isNotNull()) == (score, is_object)


def test_whole_numbers(spark):
    values = ["3000000000", "inf", "1e400", "nan", "x", None, "7", "7.9", " 12 "]
    got = [one(spark, N.to_whole(F.lit(v).cast("string"))) for v in values]
    assert got == [None, None, None, None, None, None, 7, 7, 12]
    assert one(spark, N.to_whole(F.lit("9007199254740993"), "bigint")) == 9007199254740993


def test_exact_test_at_any_size(spark):
    def exact(b, c):
        n, k = b + c, min(b, c)
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)

    for b, c in ((0, 0), (0, 5), (7, 2), (12, 12), (40, 41), (300, 310), (480, 520)):
        assert one(spark, S.mcnemar_exact(F.lit(b), F.lit(c))) == pytest.approx(exact(b, c), rel=1e-9)
    assert one(spark, S.mcnemar_exact(F.lit(600), F.lit(600))) is None


def test_reply_fields(spark):
    obj = R.parse_reply(F.lit('{"r": 0.5, "s": "1", "bad": 7, "rationale": "' + "x" * 400 + '", "no": false}'))
    yes, no = F.lit(True), F.lit(False)
    assert one(spark, R.rubric_verdict(obj, "r", yes), R.rubric_verdict(obj, "s", yes), R.rubric_verdict(obj, "bad", yes),
               R.rubric_verdict(obj, "r", no), R.rubric_verdict(obj, "gone", yes)) == (0.5, 1.0, 0.0, None, 0.0)
    assert one(spark, F.length(R.rationale(obj)), R.default_true(obj, "no"), R.default_true(obj, "gone")) == (400, False, True)
    items = R.question_items(R.parse_reply(F.lit('{"items": [{"question": " q ", "answer": "a"}, {"question": "", "answer": "b"}, 3]}')))
    assert [tuple(i) for i in one(spark, items)] == [("q", "a")]
    assert one(spark, *[R.total_tokens(F.lit(t).cast("long"), F.lit(3), F.lit(4)) for t in (0, None, 9)]) == (7, 7, 9)
    temp = lambda o, f, r: one(spark, R.effective_temperature(F.lit(o), F.lit(f).cast("double"), F.lit(r).cast("double")))
    assert (temp(True, 1.0, 0.5), temp(False, 1.0, 0.5), temp(None, None, 0.5), temp(False, None, None)) == (None, 1.0, 0.5, None)


def test_readability_by_arrays(spark):
    """The array counts follow the rules word by word; the plan holds no chain of patterns."""
    import random
    import re

    rng = random.Random(8)
    texts = ["", " ", "...", "e", "le e", "one. two three four! é œuvre 12 _ a-b- ", "table' make, e-e be\x0bthe ee \U0001d400 ٣"]
    texts += ["".join(rng.choice("aelbté \n.!-'9_") for _ in range(rng.randint(1, 80))) for _ in range(150)]

    def plain(t):
        wordy = lambda w: any(c.isalpha() or c.isnumeric() or c == "_" for c in w)
        split = lambda s: [w for w in re.split(r"[ \t\n\x0b\f\r]+", s) if w and wordy(w)]
        syllables = 0
        for w in split(t):
            groups = len(re.findall(f"[{T.VOWELS}]+", w))
            silent = groups > 1 and re.search(rf"[^{T.VOWELS}l]e[^a-zéàœ\U0001d400]*$", w)
            syllables += max(groups - bool(silent), 1)
        return len(split(t)), max(1, sum(len(split(s)) > 2 for s in re.split("[.!?]+", t))), syllables

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.readability_counts("t").alias("c"))
    assert [(r.t, tuple(r.c)) for r in df.collect()] == [(t, plain(t)) for t in texts]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp" not in plan


def test_large_inputs_get_partitions_in_proportion(spark, tmp_path, monkeypatch):
    """Four times the files, about four times the partitions; unknown and small inputs are left to Spark; numbers are the same."""
    from tallysmith.operators import calibration, common

    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(40_000).selectExpr("cast(id % 700 as string) item", "id % 7 k", "id place", "if(id % 2 = 0, 'a', 'b') judge", "id % 3 llm_score")
    rows.write.parquet(str(tmp_path / "one"))
    table = spark.read.parquet(str(tmp_path / "one"))
    twice = table.unionByName(table)
    assert common.parts_needed(table) == 0 == common.parts_needed(spark.createDataFrame([(1,)], "a int"))
    numbered = common.number_rows(table, ["k"], ["place"], "nth")
    hot = common.number_rows(table, ["k"], ["place"], "nth", hot=100, width=1_000)
    sheet = calibration.calibration_sheet(table, ["item"], ["a", "b"])
    want = [sorted(map(tuple, x.collect())) for x in (numbered, sheet)]
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    monkeypatch.setattr(common, "PART_BYTES", size // (3 * cores))
    parts = common.parts_needed(table)
    assert 3 * cores <= parts <= 3 * cores + 1 and common.parts_needed(twice.unionByName(twice)) >= 4 * (parts - 1)
    dealt = [common.number_rows(table, ["k"], ["place"], "nth"), calibration.calibration_sheet(table, ["item"], ["a", "b"])]
    assert [sorted(map(tuple, x.collect())) for x in dealt] == want
    assert all("REPARTITION_BY_NUM" in x._jdf.queryExecution().executedPlan().toString() for x in dealt)
    again = common.number_rows(table, ["k"], ["place"], "nth", hot=100, width=1_000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, hot.collect())) == want[0]


def test_sample_of_a_large_sheet(spark, tmp_path, monkeypatch):
    """The sample stands on items dealt out in proportion to the files, and is the same as from a small sheet."""
    from tallysmith.operators import calibration, common

    keys = ["source", "item_id", "area", "question_type"]
    rows = spark.range(6_000).selectExpr("'s' source", "cast(id div 2 as string) item_id", "id div 2 % 5 area", "'t' question_type", "if(id % 2 = 0, 'a', 'b') judge", "1 llm_score")
    rows.write.parquet(str(tmp_path / "long"))
    long = spark.read.parquet(str(tmp_path / "long"))
    sample = lambda: calibration.stratified_sample(calibration.calibration_sheet(long, keys, ["a", "b"]), keys[:2], 3)
    want = sorted(map(str, sample().collect()))
    monkeypatch.setattr(common, "PART_BYTES", 1_000)
    again = sample()
    assert len(want) == 15 and sorted(map(str, again.collect())) == want
    assert "REPARTITION_BY_NUM" in again._jdf.queryExecution().executedPlan().toString()


def test_calibration_deals_each_row_in_proportion(spark, small, monkeypatch):
    """No step of a large sheet stands on partitions that Spark sizes by the cores; orders are not joined with themselves."""
    from tallysmith.operators import common
    from tallysmith.plans.catalog import QUERIES

    want = sorted(map(str, QUERIES["calibration_sheet"](spark, small).collect()))
    monkeypatch.setattr(common, "PART_BYTES", 10_000)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, QUERIES["calibration_sheet"](spark, small).collect())) == want
        plan = QUERIES["calibration_sample"](spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    joins, scans = plan.count("SortMergeJoin"), plan.count("FileScan parquet [o_orderkey")
    dealt = re.findall(r"Exchange hashpartitioning\(l_partkey#\d+L, (\d+)\), (\w+)", plan)
    assert joins == 1 and scans == 1 and "hashpartitioning(l_partkey, mid" not in re.sub(r"#\d+L", "", plan)
    assert sorted(how for _, how in dealt) == ["ENSURE_REQUIREMENTS", "REPARTITION_BY_NUM"] and dealt[0][0] == dealt[1][0]


def test_rows_numbered_by_key_and_dealt_by_part_of_it(spark, tmp_path, monkeypatch):
    """Dealt by one of two keys, rows get the same numbers, where no key, some or every key is cut into ranges."""
    from tallysmith.operators import common

    rows = spark.range(6_000).selectExpr("if(id % 3 = 0, 1, if(id % 97 = 5, null, id % 40)) p", "id % 5 m", "id * 7 % 6000 place")
    rows.write.parquet(str(tmp_path / "rows"))
    table = spark.read.parquet(str(tmp_path / "rows"))
    want = sorted(map(str, common.number_rows(table, ["p", "m"], ["place"], "nth").collect()))
    for size in (common.PART_BYTES, 1_000):
        monkeypatch.setattr(common, "PART_BYTES", size)
        for hot in (1 << 20, 500, 0):
            dealt = common.number_rows(table, ["p", "m"], ["place"], "nth", hot=hot, width=1_000, deal=["p"])
            assert sorted(map(str, dealt.collect())) == want


def test_written_tables_leave_no_shuffle_files(spark):
    """Steps give back their shuffle files when their table is written, not at some garbage collection; the setting comes back."""
    import time

    from tallysmith.llm.components import connected_components
    from tallysmith.operators import common

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> set[str]:
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, own = shuffled(), spark.conf.get(setting, None)
    rows = spark.range(2_000).selectExpr("id u", "id - id % 5 v")
    sizes = rows.join(rows.groupBy("v").agg(F.count("*").alias("n")).repartition(7, "n"), "v")
    table, roots = common.checkpointed(sizes), connected_components(rows)
    until = time.time() + 5
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and table.count() == 2_000
    assert roots.groupBy("root").count().filter("count = 5").count() == 400
    assert spark.conf.get(setting, None) == own
