"""Benchmark decontamination with suffix arrays over the training text.

Documents are cut into shards of some megabytes where they lie. Each shard's words become a suffix array of all their
suffixes, sorted by prefix doubling. Every suffix of every benchmark item is then binary-searched in it, word by word,
down to the longest run of words that the shard holds. The interval in which a search stands after a whole window of words
lists all places where that window occurs; where it ends, the longest verbatim match. Documents are never shuffled, a lost
task is run again alone, and memory is bounded by the shard.

``find_leaks`` gives what each document holds, ``longest_matches`` the longest match of every suffix of every item over
all shards, however short, with its place; ``decontaminate`` removes the documents with a window.

Items come in blocks of a bounded size (``block_bytes``), and a shard is searched for one block after the other, so that a task
holds one block's suffixes. The blocks of up to ``pass_bytes`` go to the tasks at once; a larger benchmark
takes several passes, each over what the one before has written to the checkpoint folder.

Defined cases: a null or empty text has no words and no hits; an item without words is never found; an
item of fewer words than a window is one window; repeated item ids count as one item, and so do items with a null
id, under an empty one; repeated documents are rows of their own; matches of equal length go by the place in the document, then the
item; a text longer than a shard is a shard of its own; an empty table of documents gives no rows, and one of items no hits; other columns of the documents are kept, but for ``find_leaks`` those named like its results give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .sizes import small_batches, stored
from .words import Words, slices, words_of

WINDOW = 10
BLOCK_BYTES, PASS_BYTES = 8 << 20, 64 << 20
#: Text of a shard. Searches cost little more in a large one than in a small one.
SHARD_BYTES = 2 << 20
FOUND = "n_words bigint, hits array<int>, found array<string>, longest int, longest_at int, longest_item string"


@dataclass
class Suffixes:
    """All suffixes of some items: item, first word in ``words``, words, and the item's window (0 where fewer words are left)."""

    ids: list[str]
    words: np.ndarray
    item: np.ndarray
    start: np.ndarray
    length: np.ndarray
    window: np.ndarray
    first: np.ndarray


def suffixes(ids: list[str], texts: list[bytes], window: int) -> Suffixes:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    w = words_of(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    item, at = w.text_of(), np.arange(len(w.hash))
    left = w.first[1:][item] - at
    size = np.minimum(w.count, window)[item]
    return Suffixes(ids, w.hash, item, at, left, np.where(left >= size, size, 0), w.first)


class Shard:
    """The suffix array over the words of some texts, by prefix doubling (Larsson and Sadakane 1999): suffixes that agree in their first
    words form a group; groups are sorted by the rank of what follows these words, twice as many each time. Equal suffixes stay together."""

    def __init__(self, h: np.ndarray, first: np.ndarray):
        n = len(h)
        self.known, word = np.unique(h, return_inverse=True)
        self.word, self.end = word + 1, np.repeat(first[1:], np.diff(first))
        self.begin = np.searchsorted(np.sort(self.word), np.arange(len(self.known) + 2))
        pair = self.word * (len(self.known) + 1) + self._after(self.word, np.arange(n), 1)
        self.at = np.argsort(pair, kind="stable")
        self.pair = pair[self.at]
        group = _groups(self.pair)
        rank = np.empty(n, np.int64)
        rank[self.at] = group
        depth = 2
        while True:
            # A group is done when it has one suffix, or none with a word left.
            more = self.at + depth < self.end[self.at]
            open_ = (np.bincount(group, more, n)[group] > 0) & (np.bincount(group, minlength=n)[group] > 1)
            place = np.flatnonzero(open_)
            if not len(place):
                break
            i = self.at[place]
            key = rank[i] * (n + 2) + self._after(rank + 1, i, depth)
            order = np.argsort(key, kind="stable")
            self.at[place], key = i[order], key[order]
            group[place] = place[_groups(key)]
            rank[self.at[place]] = group[place]
            depth *= 2

    def _after(self, of: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
        """What ``of`` says some words further on; 0 beyond the end of the text."""
        i = at + depth
        inside = i < self.end[at]
        return np.where(inside, of[np.where(inside, i, 0)], 0)

    def bound(self, lo: np.ndarray, hi: np.ndarray, d: int, target: np.ndarray, right: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            w = self._after(self.word, self.at[mid], d)
            below = w <= target[live] if right else w < target[live]
            lo[live[below]] = mid[below] + 1
            hi[live[~below]] = mid[~below]
        return lo

    def search(self, s: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each suffix the words of its longest match, where the array holds it, and where it holds the window."""
        n = len(s.start)
        longest, best, whole = np.zeros(n, np.int64), np.zeros((2, n), np.int64), np.zeros((2, n), np.int64)
        if not n or not len(self.at):
            return longest, best[0], best[1], whole[0], whole[1]
        i = np.minimum(np.searchsorted(self.known, s.words), len(self.known) - 1)
        word = np.where(self.known[i] == s.words, i + 1, 0)
        live = np.flatnonzero(word[s.start] > 0)
        lo, hi = self.begin[word[s.start[live]]], self.begin[word[s.start[live]] + 1]
        d = 1
        while True:
            longest[live], best[0, live], best[1, live] = d, lo, hi
            done = s.window[live] == d
            whole[0, live[done]], whole[1, live[done]] = lo[done], hi[done]
            on = s.length[live] > d
            live, lo, hi = live[on], lo[on], hi[on]
            target = word[s.start[live] + d]
            on = target > 0
            live, lo, hi, target = live[on], lo[on], hi[on], target[on]
            if not len(live):
                return longest, best[0], best[1], whole[0], whole[1]
            if d == 1:
                two = word[s.start[live]] * (len(self.known) + 1) + target
                lo, hi = np.searchsorted(self.pair, two, "left"), np.searchsorted(self.pair, two, "right")
            else:
                lo = self.bound(lo, hi, d, target, False)
                hi = self.bound(lo, hi, d, target, True)
            on = lo < hi
            live, lo, hi = live[on], lo[on], hi[on]
            d += 1


def _groups(key: np.ndarray) -> np.ndarray:
    """For each entry of a sorted array the index of the first that is equal."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The interval and the place of each entry of some intervals."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def matches(w: Words, shard: Shard, s: Suffixes) -> list[tuple[list, list, int, int, str | None]]:
    """For each text the runs of hit words as first, end, ..., its items, and the longest match of a window or more, its first word and item."""
    n = len(w.first) - 1
    longest, at, item = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    hits, found = [[] for _ in range(n)], [[] for _ in range(n)]
    *_, lo, hi = shard.search(s)
    which, place = _expand(lo, hi)
    if not len(which):
        return [([], [], 0, -1, None)] * n
    begin, text, first = shard.at[place], w.text_of(), w.first
    change = np.bincount(begin, minlength=len(w.hash) + 1) - np.bincount(begin + s.window[which], minlength=len(w.hash) + 1)
    hit = np.concatenate([[0], (np.cumsum(change)[:-1] > 0).astype(np.int8), [0]])
    edge = np.diff(hit)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = first[1:-1]
    cut = cut[(cut < len(w.hash)) & (cut > 0)]
    cut = np.unique(cut[(hit[1 + cut] == 1) & (hit[cut] == 1)])
    a, b = np.sort(np.concatenate([a, cut])), np.sort(np.concatenate([b, cut]))
    for i, x, y in zip(text[a].tolist(), (a - first[text[a]]).tolist(), (b - first[text[a]]).tolist(), strict=True):
        hits[i] += [x, y]
    pairs = np.unique(np.stack([text[begin], s.item[which]]), axis=1)
    for i, k in pairs.T.tolist():
        found[i].append(s.ids[k])
    # Each place is followed beyond its window; one that only carries on another is left out.
    back = (begin > first[text[begin]]) & (s.start[which] > s.first[s.item[which]])
    on = np.flatnonzero(~(back & (w.hash[begin - 1] == s.words[s.start[which] - 1])))
    begin, which = begin[on], which[on]
    size = s.window[which].copy()
    live = np.arange(len(which))
    while len(live := live[(size[live] < s.length[which[live]]) & (begin[live] + size[live] < shard.end[begin[live]])]):
        live = live[w.hash[begin[live] + size[live]] == s.words[s.start[which[live]] + size[live]]]
        size[live] += 1
    order = np.lexsort([s.item[which], begin, -size, text[begin]])
    t = text[begin][order]
    top = order[np.concatenate([[True], t[1:] != t[:-1]])]
    where = text[begin[top]]
    longest[where], at[where], item[where] = size[top], begin[top] - first[where], s.item[which[top]]
    return list(zip(hits, [sorted({*f}) for f in found], longest.tolist(), at.tolist(), [s.ids[k] if k >= 0 else None for k in item.tolist()], strict=True))


def _merged(a: tuple, b: tuple) -> tuple:
    """What two blocks have found in one text."""
    best = min((x for x in (a, b) if x[2]), key=lambda x: (-x[2], x[3], x[4]), default=a)
    return _union(a[0] + b[0]), sorted({*a[1], *b[1]}), *best[2:]


def _union(runs: list[int]) -> list[int]:
    out: list[int] = []
    for x, y in sorted(zip(runs[::2], runs[1::2], strict=True)):
        if out and x <= out[-1]:
            out[-1] = max(out[-1], y)
        else:
            out += [x, y]
    return out


def _pass(documents: DataFrame, blocks: list[list[tuple[str, bytes]]], text: str, keep: list[str], window: int, again: bool) -> DataFrame:
    """documents with the columns of FOUND; again: joined to those that an earlier pass has found."""
    names = [f.split()[0] for f in FOUND.split(", ")]
    kept = documents.select(*keep)
    # A text that is kept goes to the workers once.
    read = text if text in keep else "__text"
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema)
    shared = documents.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = _suffixes_of(shared.value, window)
        for part, data, offsets in slices(batches, read, SHARD_BYTES):
            w = words_of(data, offsets)
            shard = Shard(w.hash, w.first)
            rows = [([], [], 0, -1, None)] * part.num_rows
            if again:
                old = [part.column(k).to_pylist() for k in range(len(keep), len(keep) + len(names) - 1)]
                rows = list(zip(*old, strict=True))
            for s in each():
                rows = [_merged(x, y) if y[0] else x for x, y in zip(rows, matches(w, shard, s), strict=True)]
            kinds = (pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(w.count, pa.int64()), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=[*keep, *names])

    source = documents.select(*keep, *(names[1:] if again else []), *([] if text in keep else [F.col(text).alias("__text")]))
    return source.mapInArrow(run, f"{schema}, {FOUND}" if schema else FOUND)


def _suffixes_of(blocks: list[list[tuple[str, bytes]]], window: int):
    """Gives the blocks' suffixes, one block after the other; those of a single block are made once."""
    make = lambda block: suffixes([i for i, _ in block], [t for _, t in block], window)
    if len(blocks) == 1:
        only = make(blocks[0])
        return lambda: [only]
    return lambda: map(make, blocks)


def passes(benchmark: DataFrame, item: str, text: str, block_bytes: int, pass_bytes: int) -> Iterator[tuple[bool, list[list[tuple[str, bytes]]]]]:
    """The items, in passes of about so many bytes, each in blocks, and whether another pass follows."""
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // pass_bytes))
    for k in range(n):
        blocks, held = [[]], 0
        for r in (items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items).toLocalIterator():
            if held > block_bytes:
                blocks, held = [*blocks, []], 0
            blocks[-1].append((r["item"], r["text"].encode()))
            held += len(blocks[-1][-1][1]) + 64
        yield k + 1 < n, [sorted(b) for b in blocks]


def find_leaks(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The kept columns of each document, n_words, hits (first and end word of each run of hit words), found (item ids),
    and the longest match with a window or more: its words, first word and item (0, -1 and null if there is none)."""
    small_batches(documents.sparkSession)
    made = [f.split()[0] for f in FOUND.split(", ")]
    keep = [c for c in (documents.columns if keep is None else keep) if c not in made and (keep is not None or c != text)]
    out, again = documents, False
    for more, blocks in passes(benchmark, item, item_text, block_bytes, pass_bytes):
        # Of what an earlier pass has made the text is read again.
        source = out.transform(stored) if again else out
        out, again = _pass(source, blocks, text, list(dict.fromkeys([*keep, text])) if more else keep, window, again), True
    return out.select(*keep, *made)


def _better(best: np.ndarray, w: Words, shard: Shard, s: Suffixes, ids: np.ndarray) -> None:
    """Puts a shard's longest matches (words, id, place) into best, where they are longer, or earlier by id and place."""
    longest, lo, hi, *_ = shard.search(s)
    better = np.flatnonzero((longest > 0) & (longest >= best[0]))
    which, place = _expand(lo[better], hi[better])
    if not len(which):
        return
    text = w.text_of()[shard.at[place]]
    at = shard.at[place] - w.first[text]
    order = np.lexsort([at, ids[text], which])
    top = order[np.concatenate([[True], which[order][1:] != which[order][:-1]])]
    i = better[which[top]]
    new, now = np.stack([longest[i], ids[text[top]], at[top]]), best[:, i]
    win = (new[0] > now[0]) | (new[0] == now[0]) & ((new[1] < now[1]) | (new[1] == now[1]) & (new[2] < now[2]))
    best[:, i[win]] = new[:, win]


def longest_matches(documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(item, item_at, words, doc_id, doc_at): of each suffix of each item with a word in some document, its first word, the words of its
    longest verbatim match in any document, however few, and the match's place with the least id, then first word.

    A task keeps the best of its shards, so that a row for each suffix leaves it."""
    small_batches(documents.sparkSession)
    out = None
    for _, blocks in passes(benchmark, item, item_text, block_bytes, pass_bytes):
        shared = documents.sparkSession.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            each, best = _suffixes_of(shared.value, window), {}
            for part, data, offsets in slices(batches, "__text", SHARD_BYTES):
                w = words_of(data, offsets)
                shard, ids = Shard(w.hash, w.first), part.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                for k, s in enumerate(each()):
                    _better(best.setdefault(k, np.zeros((3, len(s.start)), np.int64)), w, shard, s, ids)
            for k, s in enumerate(each() if best else ()):
                hit = np.flatnonzero(best[k][0])
                for low in range(0, len(hit), 50_000):
                    i = hit[low : low + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([s.ids[x] for x in s.item[i].tolist()], pa.string()), pa.array(s.start[i] - s.first[s.item[i]]), *(pa.array(x[i]) for x in best[k])], names=["item", "item_at", "words", "doc_id", "doc_at"])

        found = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("__text")).mapInArrow(run, "item string, item_at bigint, words bigint, doc_id bigint, doc_at bigint")
        out = found if out is None else out.unionByName(found)
    place = F.struct("words", (-F.col("doc_id")).alias("doc_id"), (-F.col("doc_at")).alias("doc_at"))
    top = out.groupBy("item", "item_at").agg(F.max(place).alias("p"))
    return top.select("item", "item_at", "p.words", F.when(F.col("p.doc_id") != -(2**63 - 1), -F.col("p.doc_id")).alias("doc_id"), (-F.col("p.doc_at")).alias("doc_at"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", **how) -> DataFrame:
    """The documents that hold no window of any benchmark item, with their columns as they were."""
    rest = [c for c in documents.columns if c != text]
    inner = documents.select(F.struct(*rest).alias("__row") if rest else F.lit(None).alias("__row"), F.col(text).alias("__whole"))
    found = find_leaks(inner, benchmark, text="__whole", keep=["__row", "__whole"], **how).where(F.size("found") == 0)
    return found.select(*(F.col("__whole").alias(c) if c == text else F.col("__row")[c].alias(c) for c in documents.columns))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    size = F.expr("aggregate(sequence(0, size(hits) div 2), 0L, (s, i) -> s + coalesce(get(hits, 2 * i + 1) - get(hits, 2 * i), 0))")
    return found.select(
        "doc_id", "n_words", size.alias("n_hit"), F.size("found").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("found"), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "longest", "longest_at", "longest_item",
    )
