"""Pruned vector search against all products."""

import numpy as np
import pytest

from paperloom.operators import retrieval


def brute(rows, queries, k):
    good = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in queries:
        if v and all(x is not None and np.isfinite(x) for x in v):
            scores = sorted((-round(float(np.dot(np.array(v), np.array(x))), 12), i) for i, x in good)[:k]
            out += [(q, i, round(-s, 9), n + 1) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def found(spark, rows, queries, k, **how):
    chunks = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = spark.createDataFrame(queries, "query_id bigint, v array<double>")
    got = retrieval.search(retrieval.build_cells(chunks, **how), asked, k)
    return sorted((r.query_id, r.vec_id, round(r.score, 9), r["rank"]) for r in got.rows.collect()), {r.query_id: r for r in got.read.collect()}


def clustered(seed, n, width=8, groups=20):
    draw = np.random.default_rng(seed)
    at = draw.normal(size=(groups, width)) * 4
    return [(i, (at[i % groups] + draw.normal(size=width) * 0.05).tolist()) for i in range(n)]


@pytest.mark.parametrize("cells", [1, 7, 40, None])
def test_cells_lose_nothing(spark, cells):
    rows = clustered(1, 900)
    queries = [(i, v) for i, v in rows if i % 50 == 0] + [(1000, [0.0] * 8), (1001, [1e-3] * 8), (1002, [-30.0] + [1.0] * 7)]
    got, read = found(spark, rows, queries, 6, cells=cells)
    assert got == brute(rows, queries, 6)
    assert all(0 < r.rows <= 900 and abs(r.share - r.rows / 900) < 1e-12 for r in read.values())


def test_most_of_a_clustered_table_is_not_read(spark):
    rows = clustered(2, 2000, groups=40)
    queries = rows[::100]
    got, read = found(spark, rows, queries, 5, cells=40)
    assert got == brute(rows, queries, 5)
    assert np.mean([r.share for r in read.values()]) < 0.35


def test_a_cell_of_many_rows_is_many_parts(spark, monkeypatch):
    """A third of all rows are one vector; ties go to the least id over all parts of their cell."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 8)
    monkeypatch.setattr(retrieval, "PART_BLOCKS", 2)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else v) for i, v in clustered(3, 600, 4)]
    queries = [(1, [1.0, 2.0, 3.0, 4.0]), (2, [-1.0, 0.0, 0.5, 1.0]), (3, rows[1][1])] + [(k, rows[k][1]) for k in range(10, 40)]
    chunks = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    index = retrieval.build_cells(chunks, cells=5)
    assert index.parts.max() >= 200 // 16 and index.rows.sum() == 600
    assert index.blocks.where("n > 8").isEmpty()
    assert found(spark, rows, queries, 7, cells=5)[0] == brute(rows, queries, 7)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [0.0, 1.0])]
    queries = [(1, [1.0, 1.0]), (2, None), (3, [float("inf"), 0.0])]
    assert found(spark, rows, queries, 5, cells=2)[0] == brute(rows, queries, 5) == [(1, 1, 1.0, 1), (1, 6, 1.0, 2), (1, 7, 1.0, 3)]
    assert found(spark, [(2, None)], queries, 5)[0] == []
    assert found(spark, rows, [(2, None)], 5)[0] == []
