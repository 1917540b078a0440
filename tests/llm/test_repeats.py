"""Repeated strings against brute force: every window of every text in one table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import repeats


def brute(texts, length):
    """(bytes, spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        hit = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                hit[i + 1 : i + 1 + length] = True
        out.append((len(d), np.flatnonzero(hit[1:] != hit[:-1]).tolist(), bytes(b for b, h in zip(d, hit[1:-1], strict=True) if not h)))
    return out


def got(spark, texts, parts=3, **how):
    frame = spark.createDataFrame([(i, t, -1, "s", None) for i, t in enumerate(texts)], "doc_id bigint, text string, n_bytes int, spans string, row int").repartition(parts, "doc_id").transform(repeats.stored)
    found = {r.doc_id: (r.n_bytes, list(r.spans), bytes(r.kept)) for r in repeats.find_repeats(frame, **how).collect()}
    assert len(found) == len(texts)
    return [found[i] for i in range(len(texts))]


def family(seed, n=60, words=60):
    """Copies, copies with edits, shared passages, periodic runs and accents, around the length where windows begin."""
    draw = random.Random(seed)
    vocabulary = [draw.choice(["über", "ab", "of", "thing", "ñ", "q" * 9]) + str(k) for k in range(40)]
    prose = lambda k: " ".join(draw.choice(vocabulary) for _ in range(k))
    base = [prose(words) for _ in range(4)]
    out = []
    for _ in range(n):
        t = draw.choice(base)
        kind = draw.randrange(7)
        if kind == 0:
            t = prose(draw.randrange(words))
        elif kind == 1:
            for _ in range(draw.randrange(1, 4)):
                k = draw.randrange(len(t))
                t = t[:k] + draw.choice(["X", "", "yy"]) + t[k + 1 :]
        elif kind == 2:
            k = draw.randrange(len(t))
            t = prose(5) + t[k : k + draw.randrange(10, 60)] + prose(5)
        elif kind == 3:
            t = "ab" * draw.randrange(40) + t[:30] + "\0" * draw.randrange(40)
        elif kind == 4:
            t = t[: draw.randrange(len(t))]
        elif kind == 5:
            t = t + " " + t[::-1] + t
        out.append(t)
    return out


@pytest.mark.parametrize("length, gram", [(24, 8), (25, 16), (40, 32), (16, 16)])
def test_against_all_windows(spark, length, gram):
    texts = family(length)
    assert got(spark, texts, length=length, gram=gram) == brute(texts, length)


@pytest.mark.parametrize("home_bytes", [2_000, 0])
def test_hot_homes_and_anchors(spark, monkeypatch, home_bytes):
    """Homes split by anchor, anchors counted by window, frequent anchors by broadcast, and an index for every key."""
    monkeypatch.setattr(repeats, "OFTEN", 20)
    texts = family(77, 40)
    assert got(spark, texts, length=24, gram=8, home_bytes=home_bytes, index_bytes=1) == brute(texts, 24)


def test_texts_longer_than_a_piece(spark, monkeypatch):
    draw = random.Random(5)
    long = "".join(draw.choice("abcdefgh ") for _ in range(repeats.PIECE + 5_000))
    texts = [long, "x" + long[repeats.PIECE - 700 : repeats.PIECE + 700] + "y", long[:150], None, "", "z" * 600_000]
    found = got(spark, texts)
    assert [f[0] for f in found] == [len(t or "") for t in texts]
    assert found[0][1] == [repeats.PIECE - 700, repeats.PIECE + 700] and found[1][1] == [1, 1401] and found[5][1:] == ([0, 600_000], b"")
    assert all(f[1] == [] for f in found[2:5])


def test_defined_cases(spark):
    t = "0123456789" * 15 + "".join(map(chr, range(0x100, 0x180)))
    assert len(t.encode()) > 400
    texts = [t, t, t[:-1], None, None, "", "a" * 199, "a" * 199, "b" * 200, "c" * 201]
    found = got(spark, texts)
    assert found == brute(texts, 200)
    assert found[0][2] == b"" and found[6][1] == [] and found[8][1] == [] and found[9][2] == b""
    assert repeats.find_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    no_id = spark.createDataFrame([(None, t), (None, t), (1, "x"), (1, "y")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, len(r.kept)) for r in repeats.find_repeats(no_id).collect()) == [(0, 0), (0, 0), (1, 1), (1, 1)]


@pytest.mark.parametrize("seed", range(5))
def test_run_ends_give_all_matching_statistics(seed):
    """The longest match elsewhere of each suffix, by comparing all pairs; far fewer run ends than bytes where texts repeat."""
    draw = random.Random(seed)
    base = bytes(draw.choice(b"abc\0\xff") for _ in range(30))
    texts = [base[draw.randrange(9) : draw.randrange(9, 30)] + base * draw.randrange(3) for _ in range(8)] + [b"a" * 20, b"a"]
    texts = [t for t in texts if t]
    suffixes = [t[i:] for t in texts for i in range(len(t))]

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    index = repeats.RunIndex(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))
    assert index.statistics().tolist() == [max(shared(a, b) for j, b in enumerate(suffixes) if j != i) for i, a in enumerate(suffixes)]
    whole = bytes(draw.randrange(256) for _ in range(500))
    many = repeats.RunIndex(np.frombuffer(whole * 20, np.uint8), np.arange(1, 21) * 500)
    assert len(many.head) < 1100


def test_query_on_the_table(spark, sf):
    rows = {r.doc_id: r for r in repeats.op13_repeats(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    for d, (n, spans, kept) in zip(docs, brute([d.text for d in docs], 200), strict=True):
        r = rows[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, n - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest())
