"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, then verified.

Shingles are runs of five words (fewer words are one shingle). A shingle weighs its count times the mean
inverse document frequency of its words. (The shingles' own document frequencies would make the shared text
of a large group of copies light and its few edits heavy, so that the largest groups fell apart.) Only words
in more than one of 1000 documents have a frequency of their own; there are at most a thousand times a mean
document's words of them, however many documents there are. Rarer words all weigh the most.

Each text gets 64 consistent weighted samples (Ioffe 2010). A shingle takes part in ``m`` of the 64, chosen by
its hash, so that about eight shingles compete for each: a text of thousands of shingles isn't sampled 64 times
over. ``m`` depends on the text's total weight by powers of two, and a text within a fifth below a bound is
sampled on both sides of it (a little more than a fifth, really), as two texts of similarity 0.8 differ by a fifth at most. 21 bands of three
samples make two texts of similarity 0.8 meet in a band but for about 3 in 10 million cases.

Within a band's bucket every text is first compared with the bucket's leader: a star, not all pairs. The leader is
the text with the most company over all its buckets, as a text with few edits of its own is near the most others.
Leaders with many texts are salted. Where a star leaves several classes, the bucket's other texts then meet in
blocks of bounded size, once: all similarities of a block come from one product of its incidence matrices, and only
links that join two classes leave it. A bucket of more than a block is first cut down by prefixes: its shingles are put in order, those that
a sample of its texts shares last, and of each text the first ones are taken, so many that what is left weighs less than two similar texts share. Two
similar texts have one of these in common (Chaudhuri et al. 2006), and only texts that have, meet in blocks: of texts of one template, alike only in what all have, none do. Each text of a
bucket is read once for that. After that every pair of texts that shares a bucket was compared, can't be similar, or is in one class; there are no
rounds and no pair is left out.

Verifying computes the weighted Jaccard similarity of the whole texts; a pair that shares a bucket and whose sets of
shingles, unweighted, are as similar is linked too. Classes are the connected components, found by alternating
stars of joins and minima; nothing but the frequent words goes to the driver.

Defined cases: equal word sequences are copies whatever else the texts hold; a text without words (null and
empty too) is a class of its own; a null id has a null class; rows that repeat an id are one text more of it.
A text of any length is taken whole, and is a
block of its own if it is longer than one; an empty table gives no rows. Other columns are ignored by ``classes`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .sizes import discard, if_small, small_batches, stored, stored_few
from .words import U, Words, grams, mix, slices, words_of

SHINGLE, SIMILAR, MARGIN = 5, 0.8, 0.75
SAMPLES, ROWS, BANDS = 64, 3, 21
FREQUENT = 1000
SALT = 256
#: The most ids of texts that share buckets, to be broadcast; more are joined by a shuffle.
IN_BUCKETS = 500_000


def frequent_words(documents: DataFrame, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words in more than one of ``frequent`` documents, and their inverse document frequency, 0.5 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, texts) of each part, and at word 0 the number of texts."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        texts, held = 0, 0
        for part, data, offsets in slices(batches, "text"):
            w = words_of(data, offsets)
            texts += part.num_rows
            each = [np.unique(w.hash[a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
            parts.append(np.unique(np.concatenate(each), return_counts=True))
            held += len(parts[-1][0])
            if held > 1 << 21:
                parts = [_summed(parts)]
                held = len(parts[0][0])
                if held > 1 << 21:
                    yield from _counts(parts.pop())
                    held = 0
        yield from _counts((np.zeros(1, U), np.array([texts])))
        if parts:
            yield from _counts(_summed(parts))

    counted = documents.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).transform(stored)
    texts = (counted.where("word = 0").first() or [0, 0])[1]
    common = counted.where(F.col("word") != 0).where(F.col("n") * frequent > texts).toArrow()
    words = np.array(common.column(0), dtype=np.int64).view(U)
    idf = 0.5 + 0.5 * np.log(max(texts, 1) / np.maximum(np.array(common.column(1), dtype=float), 1)) / math.log(frequent)
    order = np.argsort(words)
    return words[order], idf[order]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return words, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def _counts(pair: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(pair[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(pair[0][i : i + 50_000].view(np.int64)), pa.array(pair[1][i : i + 50_000].astype(np.int64))], names=["word", "n"])


def shingles(w: Words, t: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of a text and their weights; idf: of each word."""
    s, mean, count = _counted(w, t, idf)
    return s, mean * count


def _counted(w: Words, t: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles, the weight of one occurrence of each, and their counts."""
    a, b = int(w.first[t]), int(w.first[t + 1])
    n = min(SHINGLE, b - a)
    if n == 0:
        return np.zeros(0, U), np.zeros(0), np.zeros(0, np.int64)
    g = grams(w.hash[a:b], n)[: b - a - n + 1]
    total = np.concatenate([[0], np.cumsum(idf[a:b])])
    mean = (total[n:] - total[:-n]) / n
    s, first, count = np.unique(g, return_index=True, return_counts=True)
    return s, mean[first], count


def weights(h: np.ndarray, words: np.ndarray, idf: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.ones(len(h))
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, idf[at], 1.0)


def _uniform(h: np.ndarray, k: int) -> np.ndarray:
    return ((mix(h + U(0x9E3779B97F4A7C15 * k % 2**64)) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def samples(s: np.ndarray, weight: np.ndarray, level: int) -> np.ndarray:
    """The 64 consistent weighted samples as 64-bit numbers; 0 where no shingle takes part. level: of the total weight."""
    m = min(SAMPLES, max(1, 1 << (9 - level)))
    step = SAMPLES // m
    home = (s >> U(58)).astype(np.int64)
    bins = (home[None, :] + step * np.arange(m)[:, None]).ravel() % SAMPLES
    h = mix(np.tile(s, m) + (bins.astype(U) + U(1)) * U(0xC2B2AE3D27D4EB4F))
    log = np.tile(np.log(weight), m)
    r = -np.log(_uniform(h, 1) * _uniform(h, 2))
    c = -np.log(_uniform(h, 3) * _uniform(h, 4))
    beta = _uniform(h, 5)
    t = np.floor(log / r + beta)
    a = np.log(c) - r * (t - beta) - r
    order = np.lexsort([a, bins]) if len(a) else np.zeros(0, np.int64)
    first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]]) if len(a) else np.zeros(0, bool)
    best = order[first]
    out = np.zeros(SAMPLES, U)
    out[bins[best]] = mix(h[best] ^ mix(t[best].astype(np.int64).view(U))) | U(1)
    return out


def levels(total: float) -> list[int]:
    """The level of a total weight, and the next one if the weight is within a fifth of it."""
    level = lambda x: min(9, max(3, math.floor(math.log2(x)))) if x > 0 else 3
    return sorted({level(total), level(total / MARGIN)})


def bands(sample: np.ndarray, level: int) -> np.ndarray:
    """The bucket of each band; a band without a sample has none."""
    rows = sample[: ROWS * BANDS].reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=U) + U(level << 32)
    for k in range(ROWS):
        key = mix(mix(key) ^ rows[:, k])
    return key[(rows != 0).any(axis=1)]


def sketches(documents: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, main, print, keys, size) of each text and level. main: one row of each document; print: of its words, null without
    words; keys: its buckets; size: its words."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = shared.value
        for part, data, offsets in slices(batches, "text"):
            w = words_of(data, offsets)
            idf = weights(w.hash, words, known)
            at = (np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.count)).astype(U)
            sums = [np.concatenate([np.zeros(1, U), np.cumsum(mix(w.hash ^ mix(at * U(2) + U(k))))]) for k in (0, 1)]
            prints = np.stack([x[w.first[1:]] - x[w.first[:-1]] for x in sums], axis=1)
            rows, ids = [], part.column(0).to_pylist()
            for t, n in enumerate(w.count.tolist()):
                if not n:
                    rows.append((ids[t], True, None, [], 0))
                    continue
                s, weight = shingles(w, t, idf)
                name = prints[t].tobytes()
                for k, level in enumerate(levels(float(weight.sum()))):
                    rows.append((ids[t], k == 0, name, bands(samples(s, weight, level), level).view(np.int64), n))
            kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "main", "print", "keys", "size"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, main boolean, print binary, keys array<bigint>, size bigint")


def verified(documents: DataFrame, pairs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], similar: float = SIMILAR) -> DataFrame:
    """(a, b, similarity) of those pairs (a, b) of ids whose texts have at least the similarity. Each a's texts go to tasks of some
    hundreds of pairs, where they are held while the texts of b stream by."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts")).transform(stored_few)
    # Only leaders of many are joined to their pairs: all of a large group's pairs have one leader.
    many = if_small(salts.where("salts > 1"))
    leaders = salts.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"))
    salt = F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")
    members = pairs.join(many, "a", "left").select(F.col("b").alias("node"), "a", salt.alias("salt"), F.lit(True).alias("member"))
    texts = leaders.unionByName(members).join(documents.select(F.col("doc_id").alias("node"), "text"), "node")
    sorted_ = texts.select("a", "salt", "member", "node", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = shared.value
        now, held = None, []
        for part, data, offsets in slices(batches, "text"):
            w = words_of(data, offsets)
            idf = weights(w.hash, words, known)
            a, salt, member, node = (part.column(k).to_pylist() for k in range(4))
            found = []
            for t in range(part.num_rows):
                if (a[t], salt[t]) != now:
                    now, held = (a[t], salt[t]), []
                s, weight = shingles(w, t, idf)
                if not member[t]:
                    held.append((s, weight, weight.sum()))
                    continue
                best = max((_jaccard(x, (s, weight, weight.sum())) for x in held), default=0.0)
                if best >= similar - ROUNDING:
                    found.append((a[t], node[t], best))
            yield from _edges(found)

    return sorted_.mapInArrow(run, "a bigint, b bigint, similarity double")


def _jaccard(x: tuple[np.ndarray, np.ndarray, float], y: tuple[np.ndarray, np.ndarray, float]) -> float:
    if not len(x[0]) or not len(y[0]):
        return 0.0
    at = np.minimum(np.searchsorted(x[0], y[0]), len(x[0]) - 1)
    same = x[0][at] == y[0]
    both, shared = float(np.minimum(x[1][at[same]], y[1][same]).sum()), int(same.sum())
    return max(both / max(float(x[2] + y[2]) - both, 1e-12), shared / (len(x[0]) + len(y[0]) - shared))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of the edges (a, b): the least node of each component. Alternates large and small stars
    (Kiveris et al. 2014), by joins with each node's least neighbour, so that no neighbourhood is gathered."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().transform(stored_few)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Every edge now goes from a node to a lesser one.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = small.transform(stored_few)
        # It is done when every edge goes to a node that has no lesser one, and every node has one edge.
        if new.agg(F.count("*") - F.count_distinct("a")).first()[0] == 0 and new.join(new.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        discard(edges)
        edges = new
    return new.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


#: Of a block of texts that are compared with one another: its most texts and words (one text may have more).
BLOCK_TEXTS, BLOCK_WORDS = 2048, 500_000


#: Texts of a bucket that tell which of its shingles are common.
TELLING = 64


def narrowed(wide: DataFrame, documents: DataFrame, frequent: tuple[np.ndarray, np.ndarray], similar: float = SIMILAR) -> DataFrame:
    """wide: (key, node, label, size, n) of buckets of n texts, more than a block. (key, node, label, home, size): smaller buckets in which all pairs of different labels
    meet that may be similar, by a shingle that both have in their prefix; of groups of the same texts one is kept.

    A bucket's texts are dealt to tasks with a few of them before, which tell the order; the order is the same in all tasks."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)
    salts = F.ceil(F.col("n") / BLOCK_TEXTS).cast("int")
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node", F.lit(1)), "node"))
    telling = wide.select("key", "node", "n").withColumn("place", first).where(F.col("place") <= TELLING)
    telling = telling.select("key", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(False).alias("member"), "node", F.lit(0).cast("bigint").alias("label"), F.lit(0).cast("bigint").alias("size"))
    members = wide.select("key", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"), F.lit(True).alias("member"), "node", "label", F.col("size").cast("bigint").alias("size"))
    texts = telling.unionByName(members).join(documents.select(F.col("doc_id").alias("node"), "text"), "node")
    met = texts.select("key", "salt", "member", "node", "label", "size", "text").repartition("key", "salt").sortWithinPartitions("key", "salt", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = shared.value
        now, held, common = None, [], None
        for part, data, offsets in slices(batches, "text"):
            w = words_of(data, offsets)
            idf = weights(w.hash, words, known)
            key, salt, member, node, label, size = (part.column(k).to_pylist() for k in range(6))
            out: list[tuple[int, int, int, int, np.ndarray]] = []
            for t in range(part.num_rows):
                if (key[t], salt[t]) != now:
                    now, held, common = (key[t], salt[t]), [], None
                s, weight = shingles(w, t, idf)
                if not member[t]:
                    held.append(s)
                    continue
                if common is None:
                    common = np.unique(np.concatenate(held), return_counts=True)
                out.append((key[t], node[t], label[t], size[t], prefix(s, weight, common, similar)))
            n = [len(x[4]) for x in out]
            if sum(n):
                flat = [pa.array(np.repeat(np.array([x[k] for x in out], np.int64), n)) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*flat, pa.array(np.concatenate([x[4] for x in out]).view(np.int64))], names=["key", "node", "label", "size", "shingle"])

    rows = met.mapInArrow(run, "key bigint, node bigint, label bigint, size bigint, shingle bigint").transform(stored)
    groups = rows.groupBy("key", "shingle").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("nodes"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y")
    kept = groups.groupBy("key", "n", "nodes").agg(F.min("shingle").alias("shingle")).select("key", "shingle")
    return rows.join(kept, ["key", "shingle"]).select(F.xxhash64("key", "shingle").alias("key"), "node", "label", F.lit(False).alias("home"), "size")


def prefix(s: np.ndarray, weight: np.ndarray, common: tuple[np.ndarray, np.ndarray], similar: float) -> np.ndarray:
    """The first shingles of a text, rare ones first, of which a similar text has one: what follows them weighs less, and is fewer, than
    such texts share at least, the ``similar`` part of the larger one."""
    if not len(s):
        return s
    at = np.minimum(np.searchsorted(common[0], s), len(common[0]) - 1)
    count = np.where(common[0][at] == s, common[1][at], 0)
    order = np.lexsort([s, count])
    left = weight[order][::-1].cumsum()[::-1]
    by_weight = int((left >= (similar - ROUNDING) * left[0]).sum())
    by_number = int((np.arange(len(s), 0, -1) >= (similar - ROUNDING) * len(s)).sum())
    return s[order[: max(by_weight, by_number)]]


def crossed(rest: DataFrame, documents: DataFrame, frequent: tuple[np.ndarray, np.ndarray], similar: float = SIMILAR) -> DataFrame:
    """rest: (key, node, label, home, size), texts of buckets; home: of the leader's class; size: words. (a, b, similarity) of links between
    the texts of a bucket, as many as join its classes: all pairs are compared but those of one label.

    Those at home and the others are dealt to blocks of their own; blocks meet in pairs, but no two of those at home."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)
    blocks = lambda which: F.greatest(F.ceil(F.count_if(which) / BLOCK_TEXTS), F.ceil(F.sum(F.when(which, F.col("size")).otherwise(0)) / BLOCK_WORDS)).cast("int")
    sizes = rest.groupBy("key").agg(blocks(F.lit(True)).alias("all"), blocks(~F.col("home")).alias("apart"), blocks(F.col("home")).alias("homes"))
    sizes = sizes.select("key", F.when(F.col("all") == 1, 1).otherwise(F.col("apart")).alias("apart"), F.when(F.col("all") == 1, 0).otherwise(F.col("homes")).alias("homes"))
    within = F.col("home") & (F.col("homes") > 0)
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    placed = rest.join(sizes, "key").withColumn("own", F.when(within, F.col("apart") + block(F.greatest("homes", F.lit(1)))).otherwise(block(F.col("apart"))))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(within, F.col("apart")).otherwise(F.col("apart") + F.col("homes")) - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label")
    texts = dealt.join(documents.select(F.col("doc_id").alias("node"), "text"), "node").select("key", "i", "j", "own", "node", "label", "text")
    met = texts.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = shared.value
        now, held = None, []
        for part, data, offsets in slices(batches, "text"):
            w = words_of(data, offsets)
            idf = weights(w.hash, words, known)
            key, i, j, own, node, label = (part.column(k).to_pylist() for k in range(6))
            for t in range(part.num_rows):
                if (key[t], i[t], j[t]) != now:
                    yield from _edges(links(held, similar))
                    now, held = (key[t], i[t], j[t]), []
                held.append((own[t] == i[t], own[t] == j[t], node[t], label[t], *_counted(w, t, idf)))
        yield from _edges(links(held, similar))

    return met.mapInArrow(run, "a bigint, b bigint, similarity double")


def _edges(found: list[tuple[int, int, float]]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])


def links(block: list[tuple], similar: float) -> list[tuple[int, int, float]]:
    """block: of each text whether it stands on the one side and on the other, its node, label, shingles, their weights and counts.

    Links between the two sides that join labels, each with the similarity: a spanning forest of them, found by comparing all pairs.
    An occurrence of a shingle is an element; the weight two texts share is a product of their incidences. Elements that many texts
    have are multiplied as a dense matrix, the others gathered by their lists of texts."""
    block = sorted(block, key=lambda x: not x[0])
    label = np.array([x[3] for x in block])
    if len(block) < 2 or (label == label[0]).all():
        return []
    n, left, right, node = len(block), np.array([x[0] for x in block]), np.array([x[1] for x in block]), [x[2] for x in block]
    text = np.repeat(np.arange(n), [len(x[4]) for x in block])
    s, weight, count = (np.concatenate([x[k] for x in block]) for k in (4, 5, 6))
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    text, weight, element = np.repeat(text, count), np.repeat(weight, count), np.repeat(s, count)
    element = np.where(nth > 0, mix(element + nth.astype(U) * U(0xA0761D6478BD642F)), element)
    # Of each entry its weight, and 1 for a shingle's first occurrence, so that the second column makes the plain similarity.
    worth = np.stack([weight, nth == 0], axis=1).astype(float)
    total = np.stack([np.bincount(text, worth[:, k], n) for k in (0, 1)])
    _, which, often = np.unique(element, return_inverse=True, return_counts=True)
    keep = often[which] > 1
    text, worth, which = text[keep], worth[keep], which[keep]
    dense = often > max(16, n // 16)
    place = np.cumsum(dense) - 1
    packed = dense[which]
    matrix, each = np.zeros((n, int(dense.sum())), np.float32), np.zeros((2, int(dense.sum())), np.float32)
    matrix[text[packed], place[which[packed]]] = 1
    each[:, place[which[packed]]] = worth[packed].T
    text, worth, which = text[~packed], worth[~packed], which[~packed]
    order = np.argsort(which, kind="stable")
    members, first = text[order], np.searchsorted(which[order], np.arange(len(often) + 1))
    cost = np.cumsum(2 * n + np.bincount(text, often[which], n))
    out, begin, end = [], 0, int(left.sum())
    while begin < end:
        stop = max(begin + 1, int(np.searchsorted(cost, (cost[begin - 1] if begin else 0) + CHUNK, "right")))
        stop = min(stop, end)
        lo, hi = np.searchsorted(text, [begin, stop])
        entry, at = _expanded(first[which[lo:hi]], often[which[lo:hi]])
        flat = (text[lo:hi][entry] - begin) * n + members[at]
        like = np.zeros((stop - begin, n))
        for k in (0, 1):
            both = (matrix[begin:stop] * each[k]) @ matrix.T + np.bincount(flat, worth[lo:hi, k][entry], (stop - begin) * n).reshape(-1, n)
            like = np.maximum(like, both / np.maximum(total[k][begin:stop, None] + total[k][None, :] - both, 1e-12))
        near = (like >= similar - ROUNDING) & right
        for r in np.flatnonzero(near.any(axis=1)).tolist():
            new = np.flatnonzero(near[r] & (label != label[begin + r]))
            for k, x in dict(zip(label[new].tolist(), new.tolist(), strict=True)).items():
                out.append((node[begin + r], node[x], float(like[r, x])))
                label[label == k] = label[begin + r]
        begin = stop
    return out


#: Pairs and entries that a product takes at a time, and the error that its sums may have.
CHUNK, ROUNDING = 1 << 21, 1e-6


def _expanded(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of some runs of n places its index, and the places."""
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def classes(documents: DataFrame, *, similar: float = SIMILAR, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, class_id, copy_of): of each row the least id of its class, and the least id of its exact copies."""
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    small_batches(documents.sparkSession)
    known = frequent_words(documents, frequent)
    made = sketches(documents, known).transform(stored)
    main = made.where("main").select("doc_id", "print")
    names = main.where("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node")).transform(stored)
    kept = made.where("print is not null").join(names.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    buckets = kept.select(F.col("doc_id").alias("node"), "size", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("last"), F.count("*").alias("n")).where("least < last").select("key", "n")
    met = buckets.join(shared, "key").groupBy("key", "node").agg(F.max("size").alias("size"), F.max("n").alias("n")).transform(stored_few)
    # The order by company is one over all buckets, so that two texts meet as leader and member in one way only.
    company = met.groupBy("node").agg(F.sum("n").alias("company"))
    ranked = met.join(company, "node").withColumn("rank", F.struct("company", (-F.col("node")).alias("first")))
    leaders = ranked.groupBy("key").agg((-F.max("rank")["first"]).alias("leader"))
    hits = met.join(leaders, "key").select("key", "node", "size", "leader").transform(stored_few)
    # Texts that share a bucket are stored once.
    inside = if_small(hits.select(F.col("node").alias("doc_id")).distinct().transform(stored), IN_BUCKETS)
    held = documents.join(inside, "doc_id", "left_semi").transform(stored)
    tried = hits.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct().transform(stored_few)
    edges = verified(held, tried, known, similar).transform(stored_few)
    labels = components(edges).transform(stored_few)
    named = hits.where("node <> leader").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # A leader has met its whole bucket; what is left are buckets whose other texts are of several classes.
    split = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    home = labels.select(F.col("node").alias("leader"), F.col("label").alias("of"))
    rest = named.join(split, "key", "left_semi").join(home, "leader", "left").select("key", "node", "label", "size", (F.col("label") == F.coalesce("of", "leader")).alias("home")).transform(stored_few)
    size = rest.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("words")).where(f"n > {BLOCK_TEXTS} or words > {BLOCK_WORDS}").select("key", "n").transform(stored_few)
    blocks = rest
    if not size.isEmpty():
        large = if_small(size)
        cut = narrowed(rest.drop("home").join(large, "key"), held, known, similar).select("key", "node", "label", "home", F.col("size").cast(rest.schema["size"].dataType).alias("size"))
        blocks = rest.join(large, "key", "left_anti").unionByName(cut.transform(stored_few))
    more = crossed(blocks, held, known, similar).transform(stored_few)
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more.select("a", "b"))).transform(stored_few)
    nodes = names.join(labels, "node", "left").select("print", F.col("node").alias("copy_of"), F.coalesce("label", "node").alias("class_id"))
    discard(met, hits, held, tried, edges, rest, more)
    return main.join(nodes, "print", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("copy_of", "doc_id")).alias("copy_of"))


def deduplicate(documents: DataFrame, **how) -> DataFrame:
    """One document of each class: that of the least id; of rows that repeat it, one. Rows with a null id all stay."""
    ids = classes(documents, **how).where("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n")).transform(stored)
    gone = ids.where("class_id < doc_id").select("doc_id")
    left = documents.join(if_small(gone, IN_BUCKETS), "doc_id", "left_anti")
    repeated = ids.where("class_id = doc_id and n > 1").select("doc_id")
    if not repeated.isEmpty():
        repeated = if_small(repeated, IN_BUCKETS)
        left = left.join(repeated, "doc_id", "left_anti").unionByName(left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return left.select(*documents.columns)


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
