"""Registered text queries: SQL counterparts, brute force over the test tables, and the pipeline."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import difference, duck
from test_free import near_groups, plain_groups, plain_simhash
from test_native import plain_spots
from tallysmith.llm import langid, tokens
from tallysmith.llm.catalog import ORACLES, QUERIES

BRUTE = {
    "op1_toxicity", "op2_quality", "op5_language", "op6_spot_signatures", "op8_warc", "op9_token_counts", "op10_simhash",
    "op11_neighbours",
}


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLES) | BRUTE and not set(ORACLES) & BRUTE
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, small, name):
    assert difference(QUERIES[name](spark, small), duck(small), ORACLES[name]) is None


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


@pytest.mark.parametrize("name, label, modulus, rest, least", [("op1_toxicity", "toxic", 4, 2, 0.85), ("op2_quality", "quality", 5, 0, 0.9)])
def test_classifiers(spark, small, texts, name, label, modulus, rest, least):
    rows = QUERIES[name](spark, small).collect()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
    known = [r.predicted == truth[r.doc_id] for r in rows if r.doc_id in truth]
    assert sum(known) >= least * len(known)


def test_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = QUERIES["op5_language"](spark, small).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "fr", "es", langid.UNKNOWN) for r in rows)


def test_spots(spark, small, texts):
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    rows = QUERIES["op6_spot_signatures"](spark, small).collect()
    prints = {}
    assert len(rows) == len(texts)
    for r in rows:
        text, following = texts[r.doc_id], texts[after[r.doc_id]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        a, b, c = plain_spots(text), plain_spots(edited), plain_spots(following)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & c) / len(a | c))
        assert prints.setdefault(r.fingerprint, a) == a and prints.setdefault(r.edited_fingerprint, b) == b


def test_warc(spark, small):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    first = {}
    for p in sorted(pages):
        if len(pages[p]) >= 100:
            first.setdefault(pages[p], p)
    rows = QUERIES["op8_warc"](spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = pages[r.page_id]
        lead = first.get(body, r.page_id)
        want = (len(body), hashlib.sha256(body).hexdigest(), *(("response", None) if lead == r.page_id else ("revisit", lead)))
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want


def test_tokens(spark, small, texts):
    with open(tokens.VOCABULARY, "rb") as file:
        counts = tokens.counter(file.read())
    for r in QUERIES["op9_token_counts"](spark, small).collect():
        text = texts[r.doc_id]
        n, third = len(text), len(text) // 3
        new = text[:third] + text[third + 20 :]
        at = min(2 * third, len(new))
        new = new[:at] + " and then, again, " + new[at + 3 :]
        at = min(n, len(new))
        new = new[:at] + "\nThe end." + new[at:]
        assert r.n_tokens == len(counts.encoding.encode_ordinary(text))
        assert r.edited_tokens == len(counts.encoding.encode_ordinary(new))


def test_simhash(spark, small, texts):
    prints = {d: plain_simhash(t) for d, t in texts.items()}
    groups = plain_groups(list(prints.items()))
    for r in QUERIES["op10_simhash"](spark, small).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", groups[prints[r.doc_id]])


def test_neighbours(spark, small):
    table = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    found = {}
    for r in QUERIES["op11_neighbours"](spark, small).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {v for v in table if v % 100 == 0}
    hits = 0
    for q, rows in found.items():
        near = sorted((np.sqrt(((x - table[q]) ** 2).sum()), v) for v, x in table.items() if v != q)[:10]
        assert [r for r, _, _ in sorted(rows)] == list(range(1, 11))
        assert all(s == pytest.approx(np.sqrt(((table[v] - table[q]) ** 2).sum()), abs=1e-12) for _, v, s in rows)
        hits += len({v for _, v in near} & {v for _, v, _ in rows})
    assert hits >= 9 * len(found)


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], small).cache())
        if name != "mixing":
            assert seen[-1].columns == docs.columns, name
    good = {r.doc_id for r in QUERIES["op2_quality"](spark, small).filter("predicted = 1").collect()}
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    assert ids[1] == good and ids[2] == ids[1]
    for before, after in zip(seen[:2], seen[1:3]):
        assert after.filter("n_chars <> length(text)").count() == 0
    texts = {r.doc_id: r.text for r in seen[2].collect()}
    order = sorted(texts)
    assert ids[3] == {order[g] for g in near_groups([texts[d] for d in order])}
    from test_native import plain_contamination

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert ids[4] == {d for d in ids[3] if not plain_contamination(texts[d], items)[-1]}
    assert ids[5] == ids[4] and seen[5].filter("taken > 3 * size or taken < 0").count() == 0
    mix = seen[5].groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 1 for r in mix)
    whole = corpus_pipeline.run(spark, small)
    assert sorted(map(str, whole.collect())) == sorted(map(str, seen[5].collect()))


def test_pipeline_of_odd_tables(spark, tmp_path, messy, empty):
    """Stages stand extra columns, NULLs, repeated rows and empty tables."""
    columns = corpus_pipeline.COLUMNS
    messy.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    messy.select(*columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (2, "stone light paper")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (messy, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            assert name == "mixing" or out.columns == columns
            out.count()
