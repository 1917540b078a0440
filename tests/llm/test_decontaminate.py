import hashlib

import numpy as np

from paperloom.llm import decontaminate as d
from paperloom.llm.decontaminate import op2_decontaminate

from .test_words import WORD, lowered


def brute(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = WORD.findall(lowered(text or ""))
        k = min(window, len(w))
        for i in range(len(w) - k + 1) if k else ():
            wins.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = WORD.findall(lowered(text or "")), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    found |= wins[tuple(w[i : i + k])]
        name = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), name, bool(hit)))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = op2_decontaminate(spark, sf).collect()
    expected = brute([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    assert sorted([tuple(r)[:6] for r in got], key=str) == expected and any(r.contaminated for r in got)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "a"), (3, ""), (4, None), (None, "long"), (5, "über ñandú"), (1, "are here"), (6, "text of a row without an id, which says little")]


def items_of(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def test_odd_rows_and_blocks(spark, odd, none):
    expected = brute([(r.doc_id, r.text) for r in odd.collect()], ITEMS)
    for block, most in ((d.BLOCK_BYTES, d.PASS_BYTES), (100, d.PASS_BYTES), (100, 300)):
        found = d.find_leaks(odd, items_of(spark), block_bytes=block, pass_bytes=most)
        assert found.columns[-6:] == [f.split()[0] for f in d.FOUND.split(", ")] and "text" not in found.columns
        rows = found.collect()
        got = [(r.doc_id, len(r.hits) and sum(b - a for a, b in zip(r.hits[::2], r.hits[1::2], strict=True)), sorted(r.found)) for r in rows]
        named = [(i, h, hashlib.sha256(",".join(f).encode()).hexdigest()) for i, h, f in got]
        assert sorted(named, key=str) == sorted([(e[0], e[2], e[4]) for e in expected], key=str)
    assert d.find_leaks(none, items_of(spark)).count() == 0
    assert d.decontaminate(odd, items_of(spark).limit(0)).count() == odd.count()


def test_removal_keeps_columns(spark, odd):
    left = d.decontaminate(odd, items_of(spark))
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [3, 4, 6, 7]


def test_longest_match(spark):
    docs = spark.createDataFrame([(1, "x y one two three four five six seven eight nine ten eleven z"), (2, "one two three")], "doc_id bigint, text string")
    row = {r.doc_id: r for r in d.find_leaks(docs, items_of(spark)).collect()}
    assert (row[1].longest, row[1].longest_at, row[1].longest_item) == (11, 2, "1") and (row[2].longest, row[2].longest_at, row[2].longest_item) == (0, -1, None)


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(3)
    for n, words, texts in ((0, 1, 1), (1, 1, 1), (300, 2, 9), (400, 1, 4), (2000, 40, 30), (500, 500, 3)):
        h = rng.integers(1, words + 1, n).astype(np.uint64)
        first = np.sort(np.concatenate([[0, n], rng.integers(0, n + 1, texts - 1)]))
        shard = d.Shard(h, first)
        ends = [int(first[first > i].min()) for i in range(n)]
        suffix = lambda i: h[i : ends[i]].tolist()  # noqa: E731, B023
        assert sorted(shard.at.tolist()) == list(range(n))
        got = [suffix(i) for i in shard.at.tolist()]
        assert got == sorted(got)


def test_longest_matches_against_brute_force(spark, sf, odd):
    tables = [(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")), (odd, items_of(spark))]
    for docs, items in tables:
        texts = [(2**63 if r.doc_id is None else r.doc_id, WORD.findall(lowered(r.text or ""))) for r in docs.select("doc_id", "text").collect()]
        places = {}
        for doc, w in texts:
            for i, x in enumerate(w):
                places.setdefault(x, []).append((doc, i, w))
        expected = {}
        for item, text in [(r[0], r[1]) for r in items.collect()]:
            own = WORD.findall(lowered(text or ""))
            for k in range(len(own)):
                for doc, i, w in places.get(own[k], ()):
                    n = 1
                    while k + n < len(own) and i + n < len(w) and own[k + n] == w[i + n]:
                        n += 1
                    key = ("" if item is None else str(item), k)
                    expected[key] = min(expected.get(key, (0, 0, 0)), (-n, doc, i))
        for how in ({}, {"block_bytes": 100, "pass_bytes": 400}):
            got = {(r.item, r.item_at): (-r.words, 2**63 if r.doc_id is None else r.doc_id, r.doc_at) for r in (d.longest_matches(docs, items, **how) if docs is odd or not how else d.longest_matches(docs, items)).collect()}
            assert got == expected and min(got.values())[0] <= -9


def test_longest_match_of_each_document(spark):
    """Documents that hold a window but not the longest match of their shard have their own longest."""
    words = [f"x{i}" for i in range(40)]
    docs = [(1, words[:12]), (2, ["a", *words[5:40]]), (3, words[:30] + ["b"] + words[10:25]), (4, words[3:12])]
    found = d.find_leaks(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string"), spark.createDataFrame([(9, " ".join(words))], "item_id bigint, text string")).collect()
    split = spark.createDataFrame([(9, " ".join(words[:30])), (8, " ".join(words[4:]))], "item_id bigint, text string")
    more = d.find_leaks(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string"), split, block_bytes=1, pass_bytes=200).collect()
    assert {r.doc_id: (r.longest, r.longest_at, r.longest_item) for r in more} == {1: (12, 0, "9"), 2: (35, 1, "8"), 3: (30, 0, "9"), 4: (0, -1, None)}
    assert {r.doc_id: (r.longest, r.longest_at) for r in found} == {1: (12, 0), 2: (35, 1), 3: (30, 0), 4: (0, -1)}
