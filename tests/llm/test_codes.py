"""Vector codes against SQL, and against plain Python on ties, large numbers and broken vectors."""

import hashlib
import random

import numpy as np
import pytest

from paperloom.llm import codes

from ..oracle import same

SCHEMA = "vec_id bigint, embedding array<double>, label int, code string, error int, __label int"


def brute(table):
    """What the contract says, row by row, in Python's integers."""
    kept = [r for r in table if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2] is None, r[2] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // 8
    parts = [[[(int(x * 4096) if x * 4096 == int(x * 4096) else int(np.floor(x * 4096))) for x in r[1][p * width : (p + 1) * width]] for p in range(8)] for r in kept]
    books = [[parts[i][p] for i in range(min(16, len(kept)))] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (far(books[p][e], x), e))
    for _ in range(6):
        at = [[near(p, r[p]) for p in range(8)] for r in parts]
        for p in range(8):
            for e in range(len(books[p])):
                if mine := [r[p] for r, a in zip(parts, at, strict=True) if a[p] == e]:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out = []
    for r, x in zip(kept, parts, strict=True):
        at = [near(p, x[p]) for p in range(8)]
        out.append([r[0], "".join(f"{a:02x}" for a in at), sum(far(books[p][at[p]], x[p]) for p in range(8)), r[2]])
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return sorted(((*r[:3], total[r[3]], sha) for r in out), key=repr)


def got(spark, table):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in table], SCHEMA)
    return sorted(map(tuple, codes.compress(frame).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_a_larger_table_agrees_with_sql(spark):
    assert same(codes.op11_codes(spark, "/root/testdata/sf0.01"), codes.SQL, "/root/testdata/sf0.01") == 500


@pytest.mark.parametrize("steps", [2, 50])
def test_ties_and_repeated_rows(spark, steps):
    draw = random.Random(steps)
    table = [(k // 2 * 3, [draw.randrange(-steps, steps) / 4096 for _ in range(16)], draw.choice([None, 1, 2])) for k in range(300)]
    assert got(spark, table) == brute(table)


def test_large_components_are_exact(spark):
    """Beyond 2**53 a float can't tell neighbours apart; their squares are beyond 64 bits before differences are taken."""
    draw = random.Random(1)
    table = [(k, [3e7 * 4096 + draw.randrange(-9, 9) / 8 + (j == 3) * k for j in range(8)], k % 3) for k in range(60)]
    assert got(spark, table) == brute(table)


def test_broken_vectors_are_dropped(spark):
    draw = random.Random(2)
    fine = [(k, [draw.random() - 0.5 for _ in range(8)], k % 2) for k in range(5)]
    broken = [(-3, None, 1), (-2, [], 1), (-1, [0.5] * 7 + [None], 1), (90, [0.5] * 7 + [float("nan")], 1), (91, [float("inf")] * 8, 1), (92, [0.1] * 16, 1), (None, [0.25] * 8, None)]
    assert got(spark, fine + broken) == brute(fine + broken)
    assert got(spark, broken[:3]) == []
    assert got(spark, []) == []


def test_rare_labels_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(codes, "OFTEN", 4)
    draw = random.Random(3)
    table = [(k, [draw.random() for _ in range(8)], None if k % 3 == 0 else k) for k in range(90)]
    assert got(spark, table) == brute(table)


def test_tree_finds_the_lowest_of_equally_near_entries():
    draw = np.random.default_rng(4)
    for width in (1, 2, 8):
        book = draw.integers(-2, 3, (16, width))
        x = draw.integers(-3, 4, (500, width))
        at, far = codes.nearest(codes.tree(book), book, x)
        d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert at.tolist() == d.argmin(axis=1).tolist()
        assert far.tolist() == d.min(axis=1).tolist()
