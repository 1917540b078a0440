import random

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import minhash as m
from paperloom.llm.words import buffers

from .test_words import WORD, lowered


def made(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def shingled(text):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(800)]
    out = []
    for size in (12, 30, 60, 100, 140, 250, 260, 400, 520, 900, 3000):
        for _ in range(3):
            base = rng.choices(vocabulary, k=size)
            out.append(" ".join(base))
            for _ in range(4):
                copy = list(base)
                for _ in range(max(1, round(size * rng.choice([0.005, 0.01, 0.02])))):
                    copy[rng.randrange(size)] = rng.choice(vocabulary)
                out.append(" ".join(copy))
    return out


def test_no_link_is_lost_and_none_made_up(spark, corpus):
    got = [r.class_id for r in m.classes(made(spark, corpus)).orderBy("doc_id").collect()]
    sets = [shingled(t) for t in corpus]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert len(links) > 60 and all(got[i] == got[j] for i, j in links)
    assert all(len({x // 5 for x, c in enumerate(got) if c == k}) == 1 for k in set(got))


def test_many_copies_and_a_chain(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    copies = [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in (rng.randrange(200) for _ in range(300))]
    rows = m.classes(made(spark, copies * 2 + ["something else altogether, of eight words or so"])).collect()
    assert {r.class_id for r in rows if r.doc_id < 600} == {0} and [r.class_id for r in rows if r.doc_id == 600] == [600]
    assert all(r.copy_of < 300 for r in rows if r.doc_id < 600)


def test_odd_rows(spark, odd, none):
    rows = {(r.doc_id, r.class_id) for r in m.classes(odd).collect()}
    assert rows == {(1, 1), (2, 1), (3, 3), (4, 4), (None, None), (5, 5), (6, 6), (7, 7), (8, 8), (9, 9)}
    left = m.deduplicate(odd)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9]
    assert m.classes(none).count() == 0 and m.deduplicate(none).count() == 0


def test_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(60):
        s = np.unique(rng.integers(1, 2**63, 200, dtype=np.uint64))
        keep = rng.random(len(s)) < 0.9
        w = rng.random(len(s)) + 0.2
        a, b = m.samples(s, w, 6), m.samples(s[keep], w[keep], 6)
        agree.append(((a == b) & (a != 0)).mean() - w[keep].sum() / w.sum())
    assert abs(np.mean(agree)) < 0.02


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (32, 31), (40, 41), (41, 40)], "a bigint, b bigint")
    got = {r.node: r.label for r in m.components(edges).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 30: 30, 31: 30, 32: 30, 40: 40, 41: 40}
    assert m.components(edges.limit(0)).count() == 0


def like(x, y):
    """Weighted and plain Jaccard similarity of two texts as (shingles, weights of one occurrence, counts)."""
    a, b = ({k: (w, c) for k, w, c in zip(*(v.tolist() for v in t), strict=True)} for t in (x, y))
    low = sum(w * min(c, b[k][1]) for k, (w, c) in a.items() if k in b)
    high = sum(w * c for w, c in [*a.values(), *b.values()]) - low
    return max(low / high, len(a.keys() & b.keys()) / len(a.keys() | b.keys()))


def joined(label, pairs):
    for i, j in pairs:
        x, y = sorted((label[i], label[j]))
        label = [x if k == y else k for k in label]
    return label


@pytest.mark.parametrize("chunk", [1 << 21, 200])
def test_links_of_a_block_against_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(m, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    for n, words in ((2, 5), (40, 30), (60, 12), (90, 300)):
        idf = rng.random(words) + 0.5
        base = rng.choice(words, words // 2, replace=False)
        texts = []
        for _ in range(n):
            own = np.unique(np.where(rng.random(len(base)) < rng.choice([0.02, 0.1, 0.5]), rng.integers(0, words, len(base)), base))
            texts.append((own.astype(np.uint64), idf[own], rng.choice([1, 1, 1, 3], len(own))))
        start = [i // 2 for i in range(n)]
        for left, right in ((np.ones(n, bool), np.ones(n, bool)), (np.arange(n) % 2 == 0, np.arange(n) % 2 == 1)):
            pairs = [(i, j) for i in range(n) for j in range(n) if left[i] and right[j] and i != j and like(texts[i], texts[j]) >= 0.8]
            found = m.links([(left[i], right[i], i, start[i], *texts[i]) for i in range(n)], 0.8)
            assert all((a, b) in pairs and abs(like(texts[a], texts[b]) - x) < 1e-5 for a, b, x in found)
            assert joined(start, [(a, b) for a, b, _ in found]) == joined(start, pairs) and len(found) == len(set(start)) - len(set(joined(start, pairs)))


def test_every_pair_of_a_bucket_meets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_TEXTS", 4)
    docs = made(spark, [" ".join(f"w{i // 2}x{k}" for k in range(20)) for i in range(40)])
    rest = spark.createDataFrame([(7, i, i, i % 3 == 0, 20) for i in range(40)], "key bigint, node bigint, label bigint, home boolean, size bigint")
    got = m.crossed(rest, docs, m.frequent_words(docs)).collect()
    assert sorted((min(r.a, r.b), max(r.a, r.b)) for r in got) == [(i, i + 1) for i in range(0, 40, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_similar_texts_share_a_shingle_of_their_prefixes(seed):
    """For any sample that gives the order; weights and numbers at the threshold."""
    rng = np.random.default_rng(seed)
    near = 0
    for _ in range(400):
        n = int(rng.integers(1, 60))
        idf = rng.random(200) / 2 + 0.5
        a = rng.choice(200, n, replace=False)
        b = np.unique(np.where(rng.random(n) < rng.choice([0, 0.05, 0.1, 0.15]), rng.integers(0, 200, n), a))
        x, y = ((np.unique(t).astype(np.uint64), idf[np.unique(t)], rng.choice([1, 1, 2], len(np.unique(t)))) for t in (a, b))
        common = np.unique(rng.integers(0, 200, 300).astype(np.uint64), return_counts=True)
        p, q = (set(m.prefix(t[0], t[1] * t[2], common, 0.8).tolist()) for t in (x, y))
        if like(x, y) >= 0.8:
            near += 1
            assert p & q
        assert len(p) <= len(x[0])
    assert near > 50


def template(n, own, shared=150, seed=5):
    """Texts of one template, each with words of its own after it."""
    rng = random.Random(seed)
    base = [f"t{k}" for k in range(shared)]
    return [" ".join(base + [f"o{rng.randrange(10**9)}" for _ in range(own)]) for _ in range(n)]


@pytest.mark.parametrize("n", [300, 900])
def test_texts_of_a_template_are_dealt_once_a_bucket(spark, monkeypatch, n):
    """All share buckets and none is similar to another: rows grow with the bucket's entries and not with their square."""
    monkeypatch.setattr(m, "BLOCK_TEXTS", 100)
    monkeypatch.setattr(m, "TELLING", 8)
    seen = {}
    narrowed, crossed = m.narrowed, m.crossed

    def counted(wide, *a):
        out = narrowed(wide, *a)
        seen.update(wide=wide.count(), cut=out.count())
        return out

    monkeypatch.setattr(m, "narrowed", counted)
    monkeypatch.setattr(m, "crossed", lambda rest, *a: seen.update(blocks=rest.count()) or crossed(rest, *a))
    texts = template(n, 60)
    # Two are alike and one is a copy with an edit: they are found among the others.
    texts += [texts[3] + " more", texts[4] + " words"]
    got = [r.class_id for r in m.classes(made(spark, texts)).orderBy("doc_id").collect()]
    assert got == [*range(n), 3, 4]
    # Entries of buckets, and texts that are dealt for them: a large bucket's once to be cut down and then what is left, a small one's once.
    entries, dealt = seen["wide"] + seen["blocks"] - seen["cut"], seen["wide"] + seen["blocks"]
    assert seen["wide"] > n and dealt < 1.1 * entries


@pytest.mark.parametrize("families,members,words,edits", [(12, 25, [230], [3]), (25, 60, [150, 300, 600], [0.010, 0.014, 0.018])])
def test_families_around_the_threshold_against_brute_force(spark, monkeypatch, families, members, words, edits):
    rng = random.Random(11)
    if members == 25:
        # Buckets of more than ten texts are cut down by prefixes.
        monkeypatch.setattr(m, "BLOCK_TEXTS", 10)
        monkeypatch.setattr(m, "TELLING", 3)
    texts = []
    for f in range(families):
        n, share = words[f % len(words)], edits[f % len(edits)]
        base = [f"w{f}x{i}" for i in range(n)]
        for _ in range(members):
            copy = list(base)
            for k in rng.sample(range(n), share if share >= 1 else round(n * share)):
                copy[k] = f"n{rng.randrange(10**9)}"
            texts.append(" ".join(copy))
    docs = made(spark, texts)
    known, idf = m.frequent_words(docs)
    w = m.words_of(*buffers(pa.array(texts)))
    each = [m._counted(w, t, m.weights(w.hash, known, idf)) for t in range(len(texts))]
    pairs = [(i, j) for f in range(families) for i in range(f * members, (f + 1) * members) for j in range(f * members, i) if like(each[i], each[j]) >= 0.8]
    got = [r.class_id for r in m.classes(docs).orderBy("doc_id").collect()]
    assert all(got[i] == got[j] for i, j in pairs) and got == joined(list(range(len(texts))), pairs) and 1 < len(set(got)) < len(texts)
