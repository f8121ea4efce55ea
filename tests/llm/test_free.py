"""SimHash, components, classifiers, language, WARC and token counts against plain Python."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from conftest_llm import messy_rows
from tallysmith.llm import components, hashing, langid, linear, nearcopies, quality, simhash, tokens, toxicity, warc
from tallysmith.llm.catalog import QUERIES


# --- components and SimHash ---------------------------------------------------------------------------------

def roots(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in list(parent)}


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(5, 4), (4, 5), (None, 3), (3, None)], [(i, i + 1) for i in range(60)],
    [(-50 - i, 7) for i in range(40)], [(random.Random(i).randint(0, 80), random.Random(-i).randint(0, 80)) for i in range(55)],
])
def test_components(spark, links):
    df = spark.createDataFrame(links, "u long, v long")
    rows = components.connected_components(df).collect()
    assert len(rows) == len({r.node for r in rows}) and {r.node: r.root for r in rows} == roots(links)


def plain_simhash(text):
    lower = {i: i + 32 for i in range(65, 91)}
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    known = sorted({f for _, f in prints})
    parent = list(range(len(known)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(known):
        for j in range(i):
            if (a ^ known[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    place = {f: find(i) for i, f in enumerate(known)}
    least = {}
    for d, f in prints:
        if d is not None:
            least[place[f]] = min(least.get(place[f], d), d)
    return {f: least.get(place[f]) for f in known}


def test_simhash_of_messy_rows(messy):
    rows = messy_rows()
    prints = [(r[0], plain_simhash(r[1])) for r in rows]
    groups = plain_groups(prints)
    got = Counter(tuple(r) for r in simhash.near_duplicate_groups(messy).collect())
    assert got == Counter((d, f"{f:016x}", groups[f]) for d, f in prints)
    kept = simhash.keep_one(messy)
    want = Counter(r[0] for r, (d, f) in zip(rows, prints) if d is None or groups[f] == d)
    assert Counter(r.doc_id for r in kept.collect()) == want and kept.columns == messy.columns


def test_rows_that_share_a_key_go_one_by_one(spark):
    a, b = "one two three four five six", "seven stones lie beside the long river"
    rows = [(7, a), (3, a), (7, b), (9, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in simhash.keep_one(docs).collect()} == {(3, a), (7, b)}


def test_near_copies_by_likeness(spark, empty):
    """One row of each group stays: far fingerprints, NULL and repeated keys, a large group, texts that only come close."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(7, "a b c d e f"), (3, "A b c\nd e f"), (7, "seven stones lie beside the long river"), (9, "seven stones lie beside the long river")]
    rows += [(None, "no key here at all"), (None, "no key here at all"), (None, "another row without any key"), (50, None), (51, " ")]
    for g in range(12):
        base = [word() for _ in range(200)]
        for c in range(40 if g == 0 else 3):
            new = list(base)
            for _ in range(rng.randint(1, 6)):
                new[rng.randrange(200)] = word()
            rows.append((100 * (g + 1) + c, " ".join(new)))
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))})
    close = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    far = [p for p in close if (plain_simhash(rows[p[0]][1]) ^ plain_simhash(rows[p[1]][1])).bit_count() > 3]
    root, want = roots(close), {}
    for i, r in enumerate(rows):
        want.setdefault(root.get(i, i), []).append(r)
    want = Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in want.values())
    assert len(far) > 20 and any(len(sets[i] & sets[j]) for i in range(len(rows)) for j in range(i) if (i, j) not in set(close))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs.selectExpr("*", "'x' lang", "'y' source", "1L n_chars"), "")
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert nearcopies.keep_one(empty).count() == 0


def near_groups(texts):
    """Least index of the group of every text, by likenesses of five-word shingles over all pairs that share one."""
    sets, holders = [], {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^ \t-\r]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({" ".join(w[j : j + 5]) for j in range(max(len(w) - 4, 1))})
        for x in sets[-1]:
            holders.setdefault(x, []).append(i)
    near = Counter((a, b) for own in holders.values() for n, b in enumerate(own) for a in own[:n])
    root = roots([p for p, shared in near.items() if shared >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - shared)])
    return [root.get(i, i) for i in range(len(texts))]


def test_near_copies_in_a_crowd(spark):
    """A large family whose members are mostly less alike than 0.8: the links among them are found all the same."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(300):
        new = list(base)
        for at in rng.sample(range(150), rng.choice([1, 3, 5, 8, 12])):
            new[at] = word()
        rows.append((i, " ".join(new)))
    groups = near_groups([t for _, t in rows])
    assert 60 < len(set(groups)) < 200
    kept = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id for r in kept.collect()} == set(groups)


def test_simhash_of_an_empty_table(empty):
    assert simhash.near_duplicate_groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("distance, block", [(3, 4096), (3, 7), (1, 5), (5, 50), (0, 3)])
def test_near_links_connect_exactly_the_close(spark, distance, block):
    """Random and clustered fingerprints, and a hot bucket that is cut into blocks."""
    rng = random.Random(distance)
    known = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1, 1 << 63}
    for base in list(known)[:12]:
        known |= {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(8)}
    known |= {0xABCD << 48 | rng.getrandbits(20) for _ in range(60)}
    signed = [f - (1 << 64) if f >> 63 else f for f in known]
    prints = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = [(r.u, r.v) for r in simhash.near_links(prints, distance, block).collect()]
    bits = lambda f: f & (1 << 64) - 1
    assert all((bits(u) ^ bits(v)).bit_count() <= distance for u, v in links)
    close = [(a, b) for a in signed for b in signed if a < b and (bits(a) ^ bits(b)).bit_count() <= distance]
    assert roots(links) == roots(close)


@pytest.mark.parametrize("plan", [[(list(range(32)), 0), (list(range(32, 64)), 1)], [(list(range(48, 64)), 2)]])
def test_probes_of_a_part_with_the_highest_bit(spark, monkeypatch, plan):
    """A thresholded part that holds bit 63, as the plan of very large tables has."""
    fps = [0, -(1 << 63), 5, 5 - (1 << 63), 1 << 62, -1, (1 << 63) - 1]
    prints = spark.createDataFrame([(f,) for f in fps], "fp long")
    monkeypatch.setattr(simhash, "search_plan", lambda *_: plan)
    links = [(r.u, r.v) for r in simhash.near_links(prints, 1).collect()]
    close = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 1]
    assert len(close) == 4 and roots(links) == roots(close)


def test_search_plan_is_a_cover(spark):
    rng = random.Random(3)
    fps = [(rng.getrandbits(40) | (rng.getrandbits(1) * 0xFFFF) << 40,) for _ in range(300)]  # correlated high bits
    prints = spark.createDataFrame(fps, "fp long")
    rows, together = simhash.bit_counts(prints)
    assert rows == 300 and together[3, 3] == sum(f >> 3 & 1 for f, in fps)
    groups = simhash.group_bits(rows, together, 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and any(set(g) == set(range(40, 56)) for g in groups)
    plan = simhash.search_plan(prints)
    assert all(t >= 0 for _, t in plan) and sum(t + 1 for _, t in plan) == 4
    # costs at thresholds -1, 0, 1
    assert simhash.allocate([[0, 5, 9], [0, 1, 50], [0, 2, 4]], -1) == (3, [-1, 0, 0])
    assert simhash.allocate([[0, 5, 9], [0, 9, 50], [0, 2, 3]], -1) == (3, [-1, -1, 1])


# --- classifiers --------------------------------------------------------------------------------------------

def test_hashed_words_do_not_depend_on_their_place(monkeypatch):
    texts = ["Ab c ab", None, "", "c ab", "é ab " * 50, "z" * 300]
    for piece in (1 << 20, 16):
        monkeypatch.setattr(hashing, "PIECE", piece)
        data, begin = hashing.joined(texts)
        data = toxicity._FOLD[data]
        starts, ends = hashing.spans(toxicity._WORD[data])
        words = [bytes(data[a:b]) for a, b in zip(starts, ends)]
        hashes = hashing.span_hashes(data, starts, ends)
        by_word = {}
        for w, h in zip(words, hashes.tolist()):
            assert by_word.setdefault(w, h) == h
        assert len(set(by_word.values())) == len(by_word) == 4
        doc = np.searchsorted(begin, starts, side="right") - 1
        assert Counter(doc.tolist()) == {0: 3, 3: 2, 4: 100, 5: 1}


def test_features_are_per_document():
    texts = ["one two three two one", "ONE, two... Three!", "", None, "x"]
    for module in (toxicity, quality):
        doc, feature = module.features(texts)
        for i, text in enumerate(texts):
            d, f = module.features([text])
            assert sorted(feature[doc == i]) == sorted(f)
    doc, feature = toxicity.features(["a b c d"])
    assert len(feature) == 4 + 3 + 2


def labelled(spark, count=400, seed=1):
    rng = random.Random(seed)
    plain, bad = "lamp tree sun road cup bird wall sand fog ink".split(), "scum idiot trash".split()
    rows, labels = [], []
    for i in range(count):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic, junk = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words)):0] = [rng.choice(bad)]
        text = " ".join(w.upper() + "!!" for w in words) if junk else " ".join(words).capitalize() + "."
        rows.append((i, text))
        labels.append((i, int(not junk), int(toxic)))
    labels += [(None, 1, 1), (3, None, None), (10_000, 1, 1)] + labels[:5]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label, modulus, rest", [(toxicity, "toxic", 4, 2), (quality, "quality", 5, 0)])
def test_classifiers(spark, messy, empty, monkeypatch, module, label, modulus, rest):
    docs, labels = labelled(spark, 1500)
    monkeypatch.setattr(linear, "SHARD_ROWS", 600)
    model = module.fit(docs, labels)
    truth = {r.doc_id: r[label] for r in labels.filter(f"{label} is not null and doc_id < 10000").collect()}
    rows = module.classify(docs, model).collect()
    assert len(rows) == 1500
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows if r.held_out]) > 0.95
    again = module.fit(docs, labels)
    assert np.array_equal(model.weights, again.weights) and (model.slope, model.offset) == (again.slope, again.offset)
    odd = module.classify(messy, model)
    assert odd.columns == ["doc_id", "held_out", "score", "predicted"] and odd.count() == messy.count()
    assert odd.filter("score is null or held_out is null").count() == 0
    assert module.classify(empty, model).count() == 0
    blank = module.fit(empty, labels.limit(0))
    assert module.classify(docs, blank).select("score").distinct().count() == 1
    if module is quality:
        kept = quality.keep_good(messy, model)
        assert kept.columns == messy.columns
        assert kept.count() == odd.filter("predicted = 1").count()


def test_sample_is_bounded_and_labelled(spark):
    docs, labels = labelled(spark)
    sample = linear.labelled_sample(docs, labels, "toxic", 4, 2, rows=100)
    assert 50 < sample.count() < 160
    held = [r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    every = linear.labelled_sample(docs, labels, "toxic", 4, 2)
    assert every.count() == 400 - len(held)


def test_ratios_and_dual_descent(spark):
    docs, labels = labelled(spark, 200)
    sample = linear.labelled_sample(docs, labels, "quality", 5, 0)
    rows = sample.collect()
    good, bad = np.ones(1 << quality.DIM_BITS), np.ones(1 << quality.DIM_BITS)
    for r in rows:
        _, f = quality.features([r.text])
        (good if r.y else bad)[f] += 1
    want = np.log((good / good.sum()) / (bad / bad.sum()))
    assert np.allclose(quality.log_count_ratios(sample), want, atol=1e-5)


# --- language -----------------------------------------------------------------------------------------------

def plain_phrases(known, codes, block):
    count = 0
    for low in range(0, len(codes), block):
        part = codes[low : low + block]
        i = 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and "".join(map(chr, part[i:j])) in known:
                j += 1
            i, count = max(j - 1, i + 1), count + 1
    return count


def test_phrases(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(langid, "BLOCK", 16)
    training = {"p": "the cat sat on the mat and the rat", "q": "le chat était là, la souris", "r": "zz"}
    parser = langid.Parser(training)
    texts = ["", "x", "...", "The cat!", "là là là le rat"] + ["".join(rng.choice("theca t,éß字") for _ in range(rng.randint(1, 90))) for _ in range(40)]
    codes = [parser.alphabet.encode(t) for t in texts]
    got = parser.phrases(codes)
    for k, name in enumerate(training):
        known = "".join(map(chr, parser.alphabet.encode(training[name]).tolist()))
        assert [plain_phrases(known, c.tolist(), 16) for c in codes] == got[:, k].tolist()


def test_language(spark, messy, empty):
    rng = random.Random(4)
    words = {"en": "the house is green and tall".split(), "de": "das haus ist grün und hoch".split()}
    rows = [(i, " ".join(rng.choice(words[l]) for _ in range(12)), l) for i, l in enumerate(["en", "de"] * 60)]
    rows += [(1000, None, "en"), (1001, "123 ...", "de"), (1002, "", None), (None, "das haus", "de"), (1003, "haus", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    training = langid.training_texts(docs)
    assert set(training) == {"de", "en"}
    out = {r.doc_id: r for r in langid.identify(docs, training).collect()}
    for i, text, lang in rows[:120]:
        assert out[i].lang_pred == lang and 0.5 <= out[i].score <= 1
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1000].score == 0
    assert out[None].lang_pred == "de" and out[None].held_out is False
    assert langid.identify(messy, training).count() == messy.count()
    assert langid.identify(empty, training).count() == 0
    assert langid.training_texts(empty) == {}
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_training_text_is_never_held_out(spark):
    docs = spark.createDataFrame([(i, f"word{'abc'[zlib.crc32(str(i).encode()) % 3]}x", "l") for i in range(60)], "doc_id long, text string, lang string")
    assert "wordbx" not in langid.training_texts(docs)["l"]


def test_training_text_is_bounded(spark):
    """Many languages, long texts: no more than the stated numbers of languages, documents and characters."""
    rows = [(i, f"{i % 40} " + "abc defg " * 200, f"l{i % 40 if i % 3 else 0:02d}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_texts(docs, fit_docs=5, fit_chars=100, all_chars=4_000, languages=10)
    assert len(got) == 10 and "l00" in got
    assert all(len(t) <= 5 * 80 + 4 for t in got.values()) and sum(map(len, got.values())) <= 4_000 + 50
    assert any(not line[0].isdigit() for t in got.values() for line in t.split("\n"))


def test_sample_is_bounded_with_a_hot_key(spark):
    """One key, and NULL, on a third of the rows each: every key gives one row, so no shard grows."""
    rows = [(i, f"text {i}") for i in range(400)] + [(6, f"copy {i}") for i in range(400)] + [(None, f"none {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(6, 1), (None, 1)], "doc_id long, toxic int")
    sample = linear.labelled_sample(docs, labels, "toxic", 4, 2)
    kept = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sample.count() == len(kept) and 6 in kept
    assert sorted(r.text for r in sample.collect()) == sorted(r.text for r in linear.labelled_sample(docs.repartition(2), labels, "toxic", 4, 2).collect())


# --- WARC -----------------------------------------------------------------------------------------------------

def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(5)
    long = "".join(rng.choice("<p>é字\r\n WARC/1.1 ") for _ in range(9000))
    bodies = [None, "", "a", "x" * 99, "y" * 100, "é" * 50, long, "\r\n\r\nWARC/1.1\r\n" * 30, "0\r\n\r\n" * 40, long[:5000]]
    rows = [(i, f"http://x/{i}\r\nevil: 1", rng.choice(bodies)) for i in range(60)] + [(100, None, long), (None, "u", long), (None, "u", "lonely" * 50)]
    rows += [rows[3], rows[60]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit("z")).withColumn("type", F.lit(1)).repartition(4)
    path = str(tmp_path / "archive")
    warc.write_archives(warc.planned(pages), path, segment=700, per_file=50)
    records = warc.reassembled(warc.read_records(spark, path))
    got = Counter(tuple(r) for r in warc.resolve(warc.digests(records)).collect())
    first, want = {}, Counter()
    for p, u, h in set(rows):
        b = (h or "").encode()
        if len(b) >= 100:
            first.setdefault(b, []).append((p is None, p or 0, u or ""))
    for p, u, h in set(rows):
        b = (h or "").encode()
        lead = min(first[b]) if b in first else None
        response = lead is None or lead[:2] == (p is None, p or 0)
        want[p, len(b), hashlib.sha256(b).hexdigest(), "response" if response else "revisit", None if response else lead[1]] += 1
    assert got == want
    files = sorted((tmp_path / "archive").glob("*.gz"))
    every = [h for f in files for h, _ in warc.parse_records(gzip.decompress(f.read_bytes()))]
    kinds = Counter(h["warc-type"] for h in every)
    assert kinds["continuation"] > 5 and kinds["revisit"] > 5 and len(files) > 1
    assert all(int(h["content-length"]) <= 700 for h in every)
    texts = {r.page_id: bytes(r.payload).decode() for r in records.filter("type = 'response'").collect()}
    assert all(texts[p] == (h or "") for p, u, h in rows if p in texts and p is not None)


def test_warc_has_a_record_per_row(spark, tmp_path):
    """Repeated rows, with and without a key, come back as often as they were there."""
    long = "y" * 200
    rows = [(1, "u", long)] * 3 + [(None, "u", long)] * 2 + [(2, "v", "short")] * 2 + [(None, None, None)] * 2 + [(0, "w", "z" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in QUERIES["op8_warc"](spark, str(tmp_path)).collect())
    assert got == Counter({
        (1, 200, "response", None): 1, (1, 200, "revisit", 1): 2, (None, 200, "revisit", 1): 2,
        (2, 5, "response", None): 2, (None, 0, "response", None): 2, (0, 300, "response", None): 1,
    })


def test_warc_faults(spark):
    whole = warc.chunked(b"abc" * 10, 7)
    assert warc.dechunk(whole) == b"abc" * 10 and warc.dechunk(warc.chunked(b"")) == b""
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nabcdefgh\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
    schema = warc._READ
    head = ("1" * 32, None, "response", 1, None, 5, "u", "d", None, b"HTTP/1.1 200 OK\r\n\r\nab")
    tail = ("2" * 32, "1" * 32, "continuation", 3, 23, None, "u", "d", None, b"cd")
    middle = ("3" * 32, "1" * 32, "continuation", 2, None, None, "u", "d", None, b"xy")
    good = spark.createDataFrame([tail, head, middle, middle], schema).withColumn("total", F.when(F.col("number") == 3, 25))
    rows = warc.reassembled(good).collect()
    assert [(r.page_id, bytes(r.payload)) for r in rows] == [(5, b"abxycd")]
    for broken in ([tail, head], [head, middle], [tail, middle], [head, middle, tail[:4] + (24,) + tail[5:]]):
        with pytest.raises(Exception, match="not whole"):
            warc.reassembled(spark.createDataFrame(broken, schema)).collect()


def test_warc_of_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    path = str(tmp_path / "none")
    warc.write_archives(warc.planned(none), path)
    assert warc.resolve(warc.digests(warc.reassembled(warc.read_records(spark, path)))).count() == 0


# --- token counts -----------------------------------------------------------------------------------------------

def raw():
    with open(tokens.VOCABULARY, "rb") as file:
        return file.read()


@pytest.mark.parametrize("leaf", [4, 64])
def test_edits_count_like_the_edited_text(monkeypatch, leaf):
    monkeypatch.setattr(tokens, "LEAF", leaf)
    counts = tokens.counter(raw())
    rng = random.Random(leaf)
    letters = "ab c  \n\t'lsvedt'12.,!?éß¥字  "
    for _ in range(250):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 40, 400, 2000])))
        tree = tokens.TokenTree(text, counts)
        for _ in range(rng.randint(1, 6)):
            start, length = rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 2, 5, len(text)])
            new = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 30])))
            tree.edit(start, length, new)
            at = min(start, len(text))
            text = text[:at] + new + text[min(at + length, len(text)):]
            assert tree.text == text and tree.total == len(counts.encoding.encode_ordinary(text))
            assert tree.sums[1, 0] == len(text) and tree.pieces == len(counts.pattern.findall(text))


def test_long_texts_are_cut_between_pretokens(monkeypatch):
    counts = tokens.counter(raw())
    text = "It's  a long\n\n  text, isn't it? 12 345 \t x" * 40
    want = counts.measured(text)
    monkeypatch.setattr(tokens, "PIECE", 17)
    got = counts.measured(text)
    assert all(np.array_equal(a, b) for a, b in zip(got, want))


def test_only_the_edit_is_encoded_again():
    counts = tokens.counter(raw())
    tree = tokens.TokenTree("some words of a text " * 5000, counts)
    tree.edit(50_000, 4, "other")
    assert 0 < tree.encoded < 12


def test_count_tokens(spark, messy, empty):
    edits = F.array(
        F.struct(F.lit(2).alias("start"), F.lit(3).alias("length"), F.lit("zz y").alias("replacement")),
        F.struct(F.length("text").alias("start"), F.lit(0).alias("length"), F.lit("!").alias("replacement")),
    )
    counts = tokens.counter(raw())
    assert isinstance(counts.encoding, tiktoken.Encoding)
    got = Counter((r.doc_id, r.n_tokens, r.edited_tokens) for r in tokens.count_tokens(messy, edits).collect())
    want = Counter()
    for r in messy_rows():
        text = r[1] or ""
        new = text[:2] + "zz y" + text[5:]
        if r[1] is not None:  # the length of a NULL text is NULL, which is no edit
            new = new[: len(text)] + "!" + new[len(text):]
        want[r[0], len(counts.encoding.encode_ordinary(text)), len(counts.encoding.encode_ordinary(new))] += 1
    assert got == want
    plain = tokens.count_tokens(messy)
    assert plain.filter("n_tokens <> edited_tokens or encoded_again > 0").count() == 0
    assert tokens.count_tokens(empty, edits).count() == 0


def test_bits_of_finer_lanes_estimate_the_likeness(spark):
    common = np.arange(1_000, dtype=np.uint64)
    count = nearcopies.FINE_BANDS * nearcopies.FINE_ROWS
    def packed(own):
        hashes = np.array([xxhash.xxh64_intdigest(int(h).to_bytes(8), 1) for h in own], dtype=np.uint64)
        lowest = (nearcopies.lanes(hashes, count) & np.uint64(1)).astype(np.uint8)
        return np.packbits(lowest).view(np.int64).tolist()
    base = packed(common)
    for other, least, most in ((common, 1.0, 1.0), (common[:800], 0.73, 0.87), (common + np.uint64(5_000), -0.15, 0.15)):
        row = spark.createDataFrame([(base, packed(other))], "a array<long>, b array<long>")
        found = row.select(nearcopies.bits_shared(F.col("a"), F.col("b"))).first()[0]
        assert least <= found <= most


def test_near_copies_search_fingerprints_first(spark, monkeypatch):
    """The SimHash search runs on every distinct text; its links count only if the texts are alike enough."""
    assert nearcopies.voted(nearcopies.hashed("a B c d e f g h a b c d e", 3)[1]) == simhash.simhash("a B c d e f g h a b c d e", 3)
    rows = [(1, "a b c d e f g"), (2, "a  b c d E f g"), (3, "other words stand in this short text"), (4, "and a third text of words"), (5, "")]
    seen = []

    def all_linked(prints):
        seen.append(prints.count())
        return prints.select(F.col("fp").alias("u")).crossJoin(prints.select(F.col("fp").alias("v"))).filter("u < v")

    monkeypatch.setattr(nearcopies, "near_links", all_linked)
    kept = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert seen == [4] and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5}


def test_finer_bands_are_few_and_miss_little():
    """Each node of a crowd is written once for every finer band."""
    missed = (1 - 0.8**nearcopies.FINE_KEYED) ** nearcopies.FINE_BANDS
    assert nearcopies.FINE_BANDS <= 64 and missed < 0.001 and nearcopies.FINE_KEYED <= nearcopies.FINE_ROWS


@pytest.mark.parametrize("links, tables", [([], 1), ([(5, 1), (1, 7), (8, 2), (3, 3)], 1), ([(1, 2), (2, 3)], 2)])
def test_contraction_ends_with_stars(spark, monkeypatch, links, tables):
    """Links that are stars around their least nodes are seen to be; no round is spent on finding nothing to do."""
    written, real = [], components.checkpointed
    monkeypatch.setattr(components, "checkpointed", lambda df: written.append(df) or real(df))
    found = components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()
    ends = {frozenset(p) for p in links if p[0] != p[1]}
    whole = [{1, 5, 7}, {2, 8}] if tables == 1 and links else [{1, 2, 3}] if ends else []
    assert sorted(map(tuple, found)) == sorted((n, min(c)) for c in whole for n in c)
    assert len(written) == tables
