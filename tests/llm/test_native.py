"""Line dedup, decontamination, SpotSigs and mixing against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest_llm import messy_rows
from tallysmith.llm import decontam, lines, mixing, spotsigs

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]


def by_row(rows):
    return Counter((r[0], r[1]) for r in rows)


# --- lines ------------------------------------------------------------------------------------------------

def plain_line_dedup(rows, run=2, long=50):
    """Every run that was seen before goes; rows that repeat key and text are one document."""
    distinct = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = {}, {}
    every = []
    for d, (key, text) in enumerate(distinct):
        ls = (text or "").split("\n")
        for i in range(len(ls)):
            if i + run <= len(ls) and any(ls[i : i + run]):
                every.append((tuple(ls[i : i + run]), d, i, run))
            if run > 1 and len(re.findall(r"[^\x20\x09-\x0D]+", ls[i])) >= long:
                every.append(((ls[i],), d, i, 1))
    gone = defaultdict(set)
    for body, d, i, size in every:
        if body in seen:
            gone[d].update(range(i, i + size))
        else:
            seen[body] = (d, i)
    for d, (key, text) in enumerate(distinct):
        ls = (text or "").split("\n")
        kept = None if text is None else "\n".join(x for i, x in enumerate(ls) if i not in gone[d])
        out[key, text] = (kept, 0 if text is None else len(ls), len(gone[d]))
    return out


@pytest.mark.parametrize("run, long", [(2, 50), (3, 5), (1, 1000), (4, 50)])
def test_line_dedup(messy, run, long):
    rows = [r for r in messy_rows() if r[0] is not None or r[1] is None]
    expected = plain_line_dedup(messy_rows(), run, long)
    out = lines.dedupe_lines(messy, run=run, long=long)
    assert out.columns == [c for c in messy.columns if c != "text"] + ["text", "n_lines", "n_removed"]
    got = out.filter("doc_id is not null").select("doc_id", "text", "n_lines", "n_removed").collect()
    want = Counter((r[0], *expected[r[0], r[1]]) for r in rows if r[0] is not None)
    assert Counter(tuple(r) for r in got) == want
    assert out.count() == messy.count()


def test_lines_keep_first_and_blank(spark):
    docs = spark.createDataFrame(
        [(2, "a\nb\nc"), (1, "x\na\nb"), (3, "\n\nq\n\n"), (4, "z\n\n\ny"), (5, "p\np\np\np"), (6, "a\nb")],
        "doc_id long, text string",
    )
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedupe_lines(docs).collect()}
    assert got == {1: ("x\na\nb", 0), 2: ("c", 2), 3: ("\n\nq\n\n", 0), 4: ("z\n\n\ny", 0), 5: ("p", 3), 6: ("", 2)}


def test_lines_of_an_empty_table(empty):
    assert lines.dedupe_lines(empty).count() == 0


# --- decontamination ----------------------------------------------------------------------------------------

ITEMS = [
    (1, "This line stands in many texts and says nothing new at all and this one follows"), (2, "Stone light"),
    (3, None), (4, ""), (5, "the the the"), (6, "a"), (7, "no such words anywhere zzz"), (8, "stone LIGHT"), (None, "green"),
    (9, "word " * 20), (10, "Über être"), (9, "mouse"),
]


def plain_contamination(text, items, size=13):
    w = words(text)
    hit, found = set(), set()
    for item, body in items:
        iw = words(body)
        for s in range(max(len(iw) - size + 1, 1) if iw else 0):
            window = iw[s : s + size]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
    digest = hashlib.sha256(",".join(sorted(str(i) for i in found if i is not None)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("size", [13, 2])
def test_contamination(spark, messy, size):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("term", F.lit(1)).withColumn("phrase", F.lit("q"))
    got = decontam.contamination(messy, items, size).collect()
    want = Counter((r[0], *plain_contamination(r[1], ITEMS, size)) for r in messy_rows())
    assert Counter(tuple(r) for r in got) == want
    clean = Counter((r[0], r[1]) for r in messy_rows() if not plain_contamination(r[1], ITEMS, size)[-1] and r[0] is not None)
    kept = decontam.drop_contaminated(messy, items, size)
    assert kept.columns == messy.columns
    assert by_row(kept.filter("doc_id is not null").select("doc_id", "text").collect()) == clean


def test_contaminated_rows_go_one_by_one(spark):
    """Rows that share a key, or have none, are judged each by its own text."""
    items = spark.createDataFrame([(1, "stone light paper")], "item_id long, text string")
    bad, good = "stone light paper here", "nothing of that kind"
    rows = [(None, bad), (None, good), (None, None), (7, bad), (7, good), (7, good), (8, bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(decontam.drop_contaminated(docs, items).collect()) == by_row([r for r in rows if r[1] != bad])


def test_contamination_of_empty_tables(spark, messy, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(empty, none).count() == 0
    assert decontam.contamination(messy, none).filter("n_hit > 0 or contaminated").count() == 0


def test_joins_without_broadcast(spark, messy, monkeypatch):
    """The way beyond the size limits gives the same rows."""
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    few = sorted(map(str, decontam.contamination(messy, items).collect()))
    monkeypatch.setattr(decontam, "TERM_ROWS", 0)
    monkeypatch.setattr(decontam, "DOC_ROWS", 0)
    assert sorted(map(str, decontam.contamination(messy, items).collect())) == few


def test_phrases_and_proximity(spark):
    texts = ["red fish blue fish one two", "fish red", "blue one red two fish two", "nothing here", "two two two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = decontam.build_index(docs)
    ids = {r.doc_key: r.doc_id for r in decontam.documents(index).collect()}
    phrases = spark.createDataFrame([("red fish", ["red", "fish"]), ("two two", ["two", "two"]), ("fish", ["fish"])], "phrase string, terms array<string>")
    exact = {(ids[r.doc_key], r.start, r.phrase) for r in decontam.phrase_matches(index, phrases).collect()}
    want = {
        (d, i, " ".join(t)) for d, x in enumerate(texts) for t in (["red", "fish"], ["two", "two"], ["fish"])
        for i in range(len(x.split())) if x.split()[i : i + len(t)] == t
    }
    assert exact == want
    near = {(ids[r.doc_key], r.phrase) for r in decontam.proximity_matches(index, phrases.filter("phrase = 'red fish'"), 2).collect()}
    assert near == {(0, "red fish"), (1, "red fish"), (2, "red fish")}
    close = {(ids[r.doc_key], r.phrase) for r in decontam.proximity_matches(index, phrases.filter("phrase = 'red fish'"), 1).collect()}
    assert close == {(0, "red fish"), (1, "red fish")}


# --- SpotSigs -----------------------------------------------------------------------------------------------

def plain_spots(text):
    common = set(spotsigs.ANCHORS.split())
    w = words(text)
    content = [i for i, x in enumerate(w) if x not in common]
    found = {
        (w[i - 1], w[i], w[content[k + 1]]) for k, i in enumerate(content[:-1]) if i > 0 and w[i - 1] in common
    }
    return found or {tuple(w)}


def test_signatures(messy):
    rows = messy.select("doc_id", "text", spotsigs.signatures("text").alias("s"), spotsigs.fingerprint(spotsigs.signatures("text")).alias("f")).collect()
    prints = {}
    for r in rows:
        want = plain_spots(r.text)
        assert len(r.s) == len(want) and list(r.s) == sorted(set(r.s))
        assert prints.setdefault(r.f, want) == want and re.fullmatch("[0-9a-f]{32}", r.f)


def test_similar_sets(spark, messy):
    texts = ["the mouse ran of the river stone and the green paper light in a seven mouse " + " ".join(f"the w{i} x{i}" for i in range(30))]
    texts += [texts[0].replace(f"x{i}", "other") for i in range(6)] + ["the w1 x1 the w2 x2", ""]
    docs = messy.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    members, pairs = spotsigs.similar_sets(docs, 0.8)
    prints = {r.fingerprint for r in members.collect()}
    assert members.count() == docs.count()
    sets = {r.f: set(r.s) for r in docs.select(spotsigs.signatures("text").alias("s"), spotsigs.fingerprint(spotsigs.signatures("text")).alias("f")).collect()}
    want = {}
    for a in prints:
        for b in prints:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                want[a, b] = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    got = {(r.a, r.b): r.likeness for r in pairs.collect()}
    assert got.keys() == want.keys() and len(want) >= 10
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("bits, few", [(8, 4096), (2, 2), (1, 3)])
def test_next_document(spark, monkeypatch, bits, few):
    ids = [3, 900, 17, 18, 19, 4, 5000, -7, 1 << 40]
    docs = spark.createDataFrame([(i, f"t{i}", "k") for i in ids], "doc_id long, text string, _k string").repartition(3)
    below = spotsigs._block_below
    monkeypatch.setattr(spotsigs, "_block_below", lambda b, n, f=few: below(b, max(n, 1), f))
    got = {r.doc_id: (r.text, r.next_text) for r in spotsigs.with_next(docs, ["text"], bits=bits).collect()}
    order = sorted(ids, reverse=True)
    assert got == {a: (f"t{a}", f"t{b}") for a, b in zip(order, order[1:] + order[:1])}


def test_next_of_messy_and_empty(messy, empty):
    out = spotsigs.with_next(messy, ["text"])
    assert out.count() == messy.count() and sorted(out.columns) == sorted([*messy.columns, "next_text"])
    assert spotsigs.with_next(empty, ["text"]).count() == 0


# --- mixing -------------------------------------------------------------------------------------------------

def plain_targets(sizes, weights, repeats=3):
    total, open_, out = sum(sizes.values()), set(sizes), {}
    while True:
        rest = total - sum(out.values())
        share = sum(weights[s] for s in open_)
        level = {s: rest * weights[s] / share for s in open_ if share}
        over = {s for s in level if level[s] > repeats * sizes[s]}
        if not over:
            return {**out, **level}
        for s in over:
            out[s] = float(repeats * sizes[s])
        open_ -= over


def test_mix(messy):
    rows = [(r[0], r[1], r[3]) for r in messy_rows()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += size(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    want = plain_targets(sizes, weights)
    got = mixing.mix(messy).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, size(t)) for d, t, s in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(messy.repartition(5)).collect()))


def test_mix_orders_by_weighted_keys(spark):
    rows = [(i, 5, "s", 4.0 if i % 2 else 0.25) for i in range(4000)] + [(9000, 20_000, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, source string, q double")
    weights = spark.createDataFrame([("s", 1.0), ("t", 9.0)], "source string, weight double")
    got = mixing.mix_sized(docs, weights, quality="q").filter("source = 's'").collect()
    u = lambda i: (int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
    key = {i: -math.log(u(i)) / q for i, _, s, q in rows if s == "s"}
    goal, want = round(got[0].target), {}
    for i in sorted(key, key=key.get):
        want[i] = min(5, max(0, goal))
        goal -= want[i]
    assert {r.doc_id: r.taken for r in got} == want
    picked = [r.doc_id for r in got if r.taken]
    assert 0 < len(picked) < 4000 and sum(i % 2 for i in picked) > 0.8 * len(picked)


def test_mix_of_odd_tables(spark, empty):
    assert mixing.mix(empty).count() == 0
    hollow = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(hollow).collect()] == [0, 0]
    one = spark.createDataFrame([(1, "a b c", "a")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(one).collect()] == [(3.0, 3)]
    nothing = spark.createDataFrame([], "source string, weight double")
    assert [(r.target, r.taken) for r in mixing.mix(one, weights=nothing).collect()] == [(0.0, 0)]


def test_mix_without_broadcast(messy, monkeypatch):
    few = sorted(map(str, mixing.mix(messy).collect()))
    monkeypatch.setattr(mixing, "SOURCE_ROWS", 0)
    assert sorted(map(str, mixing.mix(messy).collect())) == few


def test_no_python_on_the_main_path(messy, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for df in (lines.dedupe_lines(messy), decontam.contamination(messy, items), mixing.mix(messy), messy.select(spotsigs.signatures("text"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
