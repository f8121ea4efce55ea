"""Divergences of sources: SQL on odd tables, small tiles, and the quadtree alone."""

import numpy as np
import pytest

from compare import difference, duck
from tallysmith.llm import divergence, oracles


def test_quadtree_finds_every_filled_column():
    rng = np.random.default_rng(2)
    for rows, columns, density in [(1, 1, 1), (3, 9, 0.2), (17, 5, 0.5), (6, 40, 0.02), (4, 4, 0)]:
        filled = rng.random((rows, columns)) < density
        shares = rng.integers(1, 1000, (rows, columns))
        paired = rng.random((rows, rows)) < 0.7
        value, touched = divergence.traverse(filled, shares, paired)
        for a in range(rows):
            for b in range(rows):
                use = (filled[a] | filled[b]) & paired[a, b]
                assert touched[a, b] == use.sum()
                assert value[a, b] == ((shares[a] - shares[b]) ** 2 // shares[b])[use].sum()


def test_levels_of_the_tree():
    cells = np.zeros((8, 8), dtype=bool)
    cells[5, 2] = True
    assert [np.argwhere(level).tolist() for level in divergence.quadrants(cells)] == [[[5, 2]], [[2, 1]], [[1, 0]], [[0, 0]]]


def stored(spark, rows, path):
    rows.select("doc_id", "text", "lang", "source").write.parquet(f"{path}/documents.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


@pytest.mark.parametrize("groups, terms, front, piece", [(64, 256, 1 << 20, 16 << 20), (2, 3, 5, 4)])
def test_odd_tables(spark, messy, tmp_path, monkeypatch, groups, terms, front, piece):
    """NULLs, repeated rows, groups without terms, many small tiles."""
    monkeypatch.setattr(divergence, "TILE_GROUPS", groups)
    monkeypatch.setattr(divergence, "TILE_TERMS", terms)
    monkeypatch.setattr(divergence, "FRONT", front)
    monkeypatch.setattr(divergence, "PIECE", piece)
    stored(spark, messy, str(tmp_path))
    assert difference(divergence.audit(messy), duck(str(tmp_path)), oracles.DIVERGENCE) is None


def test_no_kept_terms_and_no_rows(spark, empty, tmp_path):
    assert divergence.audit(empty).collect() == []
    rows = spark.createDataFrame([(1, "one", "xx", "a"), (2, None, "xx", "b"), (3, "two", None, None)], "doc_id long, text string, lang string, source string")
    got = divergence.audit(stored(spark, rows, str(tmp_path)))
    assert sorted((r.lang, r.source, r.item, r["value"]) for r in got.collect()) == [("xx", "a", "b", 0), ("xx", "b", "a", 0)]
    assert difference(got, duck(str(tmp_path)), oracles.DIVERGENCE) is None


def test_large_counts_are_exact(spark):
    one = spark.range(1).selectExpr("9000000000000000 AS n", "9100000000000000 AS size", "3 AS kinds")
    want = 1 + 1_000_000_000 * 9_000_000_000_000_001 // 9_100_000_000_000_003
    assert one.select(divergence.share("n", "size", "kinds").alias("p")).first().p == want
