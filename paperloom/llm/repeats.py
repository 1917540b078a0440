"""Suffix-array dedup with a run-length index: every byte of a repeated string of ``LENGTH`` bytes is found, wherever its copies lie.

*Bringing copies together.* The ``LENGTH`` bytes from any byte on (a window) have an anchor: of the window's ``GRAM``-byte strings the one of
the least hash, the first of equal ones. It hangs on the window's bytes alone, so that equal windows have equal anchors. Consecutive windows mostly share one; such a run
of windows is a passage: the hash of its anchor, the hash of its bytes, its place and its number of windows. Passages whose
anchor occurs once hold nothing repeated and go no further. Of the others each different passage is kept once, with the number of times it occurs: the
place with the least row stands for all. An anchor's home is the least row that has it. All passages of an anchor go to its home's index; as the passages of one document, and
of its near copies, mostly have one home, neighbours are joined there again into one piece of text, and bytes that passages share are indexed once.

*The index.* A task takes homes of about ``INDEX_BYTES`` together. Their text's suffixes are sorted (prefix doubling from seven bytes), the bytes before them are
the Burrows-Wheeler transform, and this is cut into runs of equal bytes. What is kept are the run ends: at the head of a run the text position of the suffix and
the length it shares with the suffix before, at the tail that with the suffix after. Inside runs nothing is stored. The text is then streamed once: from one position
to the next both lengths drop by one unless the position is a sampled run end, so that the larger is its matching statistic, the longest match elsewhere in
the index. A window is repeated where this reaches LENGTH, or where its passage occurs twice or more: its copy has just not been indexed again.

*Hot groups.* Homes with more than ``HOME_BYTES`` of passages are split by anchor; an anchor with so much (thousands of different
surroundings of one string) goes by its windows: their 128-bit hashes are counted, summed up by task first.

Rows are told apart by their place in the scan: a plan whose rows may come in another order when it is worked out again has to be stored first. Hashes of anchors and
passages are 128 bits together; the index compares bytes.

Defined cases: a null text is an empty one; texts of fewer bytes than LENGTH have no window and lose nothing; of copies all lose their
bytes, the first included; matches may overlap themselves; a cut may fall inside a character, so what is kept is binary; repeated
rows, and rows with a repeated or null id, are texts of their own; an empty table gives no rows; of clashing names the results' stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .sizes import discard, forget, if_small, small_batches, stored
from .words import PIECE, U, _tables, buffers, mix, slices

LENGTH, GRAM = 200, 32
INDEX_BYTES, HOME_BYTES = 1 << 20, 1 << 20
#: An anchor with more than one in so many of all passages is joined by broadcast.
OFTEN = 1000

PASSAGE = np.dtype([("h", "<i8"), ("c", "<i8"), ("s", "<i4"), ("n", "<i4")])
PART = np.dtype([("h", "<i8"), ("c", "<i8"), ("at", "<i4"), ("n", "<i4"), ("times", "<i8")])


def _hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes from each byte on; gram is a multiple of eight."""
    n = len(data) - gram + 1
    eight = np.zeros(len(data) - 7, U)
    for k in range(8):
        eight |= data[k : len(data) - 7 + k].astype(U) << U(8 * k)
    h = mix(eight[:n] + U(1))
    for k in range(8, gram, 8):
        h = mix(h ^ eight[k : n + k] * U(0x9E3779B97F4A7C15))
    return h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of width entries from each on."""
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def passages(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The text of each passage of some texts, and the passages; together the texts have PIECE bytes at most."""
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets - base
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, PASSAGE)
    h = _hashes(data, gram)
    bits = U((1 << PIECE.bit_length()) - 1)
    anchor = (_least((h & ~bits) | np.arange(len(h), dtype=U), length - gram + 1) & bits).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    at = np.flatnonzero(np.arange(len(anchor)) + length <= offsets[1:][text])
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, PASSAGE)
    anchor, text = anchor[at], text[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    start, text = at[first], text[first]
    power, inverse = _tables(len(data))
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=sums[1:])
    out = np.empty(len(first), PASSAGE)
    out["h"], out["s"], out["n"] = h[anchor[first]].view(np.int64), start - offsets[text], n
    out["c"] = mix((sums[start + n + length - 1] - sums[start]) * inverse[start]).view(np.int64)
    return text, out


def anchored(documents: DataFrame, text: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, passages): the packed passages of each text that has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = PIECE - length + 1
        for part, data, offsets in slices(batches, "text", PIECE):
            if part.num_rows == 1 and offsets[1] - offsets[0] > PIECE:
                found = []
                for low in range(int(offsets[0]), int(offsets[1]) - length + 1, step):
                    _, p = passages(data, np.array([low, min(low + PIECE, int(offsets[1]))]), length, gram)
                    p["s"] += low - int(offsets[0])
                    found.append(p)
                of, p = np.zeros(sum(map(len, found)), np.int64), np.concatenate(found)
            else:
                of, p = passages(data, offsets, length, gram)
            if not len(p):
                continue
            texts, first = np.unique(of, return_index=True)
            ends = [*first[1:].tolist(), len(p)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(texts)), pa.array([p[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)], pa.binary())], names=["row", "passages"])

    return _numbered(documents, text).mapInArrow(run, "row bigint, passages binary")


def _numbered(documents: DataFrame, text: str, *keep: Column) -> DataFrame:
    return documents.select(F.monotonically_increasing_id().alias("row"), *keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def _shrunk(documents: DataFrame, text: str, *keep: Column) -> DataFrame:
    """The numbered rows with their text as ``zipped``: texts are shuffled by row, and as columns in blocks of a shuffle they shrink less."""
    numbered = _numbered(documents, text, *keep)
    names = [c for c in numbered.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for b in batches:
            data, offsets = buffers(b.column(b.num_columns - 1))
            some = memoryview(data)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([zip_.compress(some[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())], names=[*names, "zipped"])

    return numbered.select(*names, "text").mapInArrow(run, T.StructType([*(numbered.schema[c] for c in names), T.StructField("zipped", T.BinaryType())]))


def _opened(column: pa.Array) -> Iterator[np.ndarray]:
    """The texts' bytes."""
    unzip = zstandard.ZstdDecompressor()
    data, offsets = buffers(column)
    some = memoryview(data)
    for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield np.frombuffer(unzip.decompress(some[x:y]), np.uint8)


def _unpacked(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The place in the column of each packed entry, and the entries."""
    data, offsets = buffers(column)
    return np.repeat(np.arange(len(column)), np.diff(offsets) // dtype.itemsize), np.frombuffer(data[int(offsets[0]) : int(offsets[-1])].tobytes(), dtype)


def _each(table: DataFrame) -> DataFrame:
    """(h, c, row, s, n) of each passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, p = _unpacked(b.column(1), PASSAGE)
            row = b.column(0).to_numpy()[at]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p["h"], p["c"], row, p["s"], p["n"])], names=["h", "c", "row", "s", "n"])

    return table.mapInArrow(run, "h bigint, c bigint, row bigint, s int, n int")


def _repeated(table: DataFrame) -> DataFrame:
    """(h, home, times) of each anchor that occurs twice or more; a batch's copies are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, p = _unpacked(b.column(1), PASSAGE)
            row = b.column(0).to_numpy()[at]
            h, first, back = np.unique(p["h"], return_index=True, return_inverse=True)
            home = row[first].copy()
            np.minimum.at(home, back, row)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(home), pa.array(np.bincount(back, minlength=len(h)))], names=["h", "home", "times"])

    return table.mapInArrow(run, "h bigint, home bigint, times bigint").groupBy("h").agg(F.min("home").alias("home"), F.sum("times").alias("times")).where("times > 1")


def different(table: DataFrame) -> DataFrame:
    """(home, h, c, times, row, s, n): each different passage with a repeated anchor, and the least place of it."""
    repeated = _repeated(table).transform(stored)
    total = repeated.agg(F.sum("times")).first()[0] or 0
    often, rest = (repeated.where(f"times * {OFTEN} {sign} {total}").select("h", "home") for sign in (">", "<="))
    each = _each(table)
    found = each.join(rest, "h")
    if not often.isEmpty():
        # The frequent anchors go by broadcast, a thousand at most: no task gets all that share one. The rest is joined by a shuffle.
        known = each.join(F.broadcast(often), "h", "left")
        found = known.where("home is not null").unionByName(known.where("home is null").drop("home").join(rest, "h"))
    place = F.min(F.struct("row", "s")).alias("place")
    out = found.groupBy("home", "h", "c").agg(F.count("*").alias("times"), place, F.min("n").alias("n")).select("home", "h", "c", "times", "place.row", "place.s", "n").transform(stored)
    discard(repeated)
    forget(table.sparkSession)
    return out


def keyed(different: DataFrame, length: int, home_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """The passages with the key of their index, and those of hot anchors, which have none."""
    size = F.sum(F.col("n") + (length - 1)).alias("__size")
    homes = different.groupBy("home").agg(size).where(F.col("__size") > home_bytes).select("home", F.lit(True).alias("__hot")).transform(stored)
    whole = F.struct(F.lit(0).alias("of"), F.col("home").alias("id")).alias("key")
    if homes.isEmpty():
        return different.select(whole, *different.columns), None
    marked = different.join(if_small(homes), "home", "left")
    cool = marked.where("__hot is null").select(whole, *different.columns)
    hot = marked.where("__hot").drop("__hot").transform(stored)
    anchors = hot.groupBy("h").agg(size).where(F.col("__size") > home_bytes).select("h", F.lit(True).alias("__hot")).transform(stored)
    marked = hot.join(if_small(anchors), "h", "left")
    split = marked.where("__hot is null").select(F.struct(F.lit(1).alias("of"), F.col("h").alias("id")).alias("key"), *different.columns)
    return cool.unionByName(split), None if anchors.isEmpty() else marked.where("__hot").select(*different.columns)


def pieces(keyed: DataFrame, documents: DataFrame, text: str, length: int = LENGTH) -> DataFrame:
    """(of, id, bytes, parts): the passages' text, neighbours of one key joined to one piece, and where in it each passage lies."""
    wanted = keyed.groupBy("row").agg(F.collect_list(F.struct("key.of", "key.id", "h", "c", "s", "n", "times")).alias("passages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lists = list(_opened(b.column(0))), b.column(1)
            doc, flat = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten()
            order = np.lexsort([flat.field("s").to_numpy(), doc])
            of, id_, h, c, s, n, times = (flat.field(k).to_numpy()[order] for k in range(7))
            doc = doc[order]
            joined = (doc[1:] == doc[:-1]) & (of[1:] == of[:-1]) & (id_[1:] == id_[:-1]) & (s[1:] == s[:-1] + n[:-1])
            first = np.flatnonzero(np.concatenate([[True], ~joined]))
            last = np.append(first[1:], len(doc)) - 1
            parts = np.empty(len(doc), PART)
            parts["h"], parts["c"], parts["n"], parts["times"] = h, c, n, times
            parts["at"] = s - np.repeat(s[first], last - first + 1)
            low, high = s[first], s[last] + n[last] + length - 1
            some = [texts[d][a:z].tobytes() for d, a, z in zip(doc[first].tolist(), low.tolist(), high.tolist(), strict=True)]
            packed = [parts[a : z + 1].tobytes() for a, z in zip(first.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(of[first]), pa.array(id_[first]), pa.array(some, pa.binary()), pa.array(packed, pa.binary())], names=["of", "id", "bytes", "parts"])

    joined = _shrunk(documents, text).join(wanted, "row").select("zipped", "passages")
    return joined.mapInArrow(run, "of int, id bigint, bytes binary, parts binary")


class RunIndex:
    """The run-length Burrows-Wheeler transform of some pieces of text, each ended by an end of its own, with sampled run ends.

    head: the text position at the head of each run, tail: that at the tail of the run before it, shared: the bytes that the two suffixes share."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.n = n = len(data)
        self.left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)
        order = self._sorted(data)
        before = np.where(order > 0, data[order - 1].astype(np.int16), -1)
        start = np.zeros(n + 1, bool)
        start[0] = start[ends] = True
        # Ends are all different, so that a piece's first suffix is a run of its own.
        change = np.flatnonzero((before[1:] != before[:-1]) | start[order[1:]] | start[order[:-1]]) + 1
        self.first, self.last = order[:1], order[-1:]
        self.head, self.tail = order[change], order[change - 1]
        self.shared = self._shared(data, self.head, self.tail)

    def _sorted(self, data: np.ndarray) -> np.ndarray:
        """All suffixes in order; a piece's end is below all bytes, and ends go by their place."""
        n, left = self.n, self.left
        key, depth = np.zeros(n, np.int64), 7
        padded = np.concatenate([data.astype(np.int64) + 1, np.zeros(depth, np.int64)])
        for k in range(depth):
            key = key << 9 | padded[k : n + k]
        keep = np.array([~((1 << 9 * (depth - k)) - 1) for k in range(depth + 1)])
        key &= keep[np.minimum(left, depth)]
        order = np.argsort(key)
        group = _firsts(key[order])
        rank = np.empty(n, np.int64)
        rank[order] = group
        place = np.arange(n)
        while True:
            # A group is done when it has one suffix, or none that goes on.
            size = np.bincount(group, minlength=n)
            more = np.bincount(group[place], left[order[place]] > depth, n)
            place = place[(size[group[place]] > 1) & (more[group[place]] > 0)]
            if not len(place):
                break
            i = order[place]
            after = np.where(left[i] > depth, rank[np.minimum(i + depth, n - 1)] + 1, 0)
            key = group[place] * (n + 1) + after
            turn = np.argsort(key)
            i, key = i[turn], key[turn]
            order[place], group[place] = i, place[_firsts(key)]
            rank[i] = group[place]
            depth *= 2
        tied = np.flatnonzero(np.bincount(group, minlength=n)[group] > 1)
        order[tied] = np.sort(group[tied] * n + order[tied]) % n
        return order

    def _shared(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The bytes that the suffixes from a and from b on share, eight at a time and then one by one."""
        most, out = np.minimum(self.left[a], self.left[b]), np.zeros(len(a), np.int64)
        eight = np.zeros(self.n, U)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        for k in range(8):
            eight |= padded[k : self.n + k].astype(U) << U(8 * k)
        live = np.arange(len(a))
        while len(live := live[out[live] + 8 <= most[live]]):
            live = live[eight[a[live] + out[live]] == eight[b[live] + out[live]]]
            out[live] += 8
        live = np.arange(len(a))
        while len(live := live[out[live] < most[live]]):
            live = live[data[a[live] + out[live]] == data[b[live] + out[live]]]
            out[live] += 1
        return out

    def statistics(self) -> np.ndarray:
        """For each position the longest match of its suffix elsewhere: both neighbours' lengths drop by one a byte between sampled run ends."""
        out = np.zeros(self.n, np.int64)
        for at, none in ((self.head, self.first), (self.tail, self.last)):
            known = np.full(self.n, -1, np.int64)
            known[at], known[none] = self.shared, 0
            sample = np.maximum.accumulate(np.where(known >= 0, np.arange(self.n), 0))
            np.maximum(out, known[sample] - (np.arange(self.n) - sample), out=out)
        return out


def _firsts(key: np.ndarray) -> np.ndarray:
    """For each entry of a sorted array the index of the first that is equal."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def marked(texts: list[bytes], parts: np.ndarray, sizes: list[int], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The repeated windows of some pieces' passages: passage, first and end of each run of windows, from the passage's first."""
    ends = np.cumsum([len(t) for t in texts])
    match = RunIndex(np.frombuffer(b"".join(texts), np.uint8), ends).statistics() >= length
    at = parts["at"] + np.repeat(ends - [len(t) for t in texts], sizes)
    n = parts["n"].astype(np.int64)
    of = np.repeat(np.arange(len(parts)), n)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    hit = match[at[of] + inside] | (parts["times"] > 1)[of]
    begin = hit & ((inside == 0) | ~np.concatenate([[False], hit[:-1]]))
    end = hit & ((inside == n[of] - 1) | ~np.concatenate([hit[1:], [False]]))
    return of[begin], inside[begin], inside[end] + 1


def repeated_windows(pieces: DataFrame, index_bytes: int, length: int = LENGTH) -> DataFrame:
    """(h, c, a, b): runs of repeated windows of each passage, from its first window. Pieces of a key are in one index."""
    size = pieces.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    spark = pieces.sparkSession
    tasks = max(1, -(-size // (4 * index_bytes)), min(spark.sparkContext.defaultParallelism, size // 65536))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        bytes_, key = 0, None

        def index() -> pa.RecordBatch:
            parts = np.frombuffer(b"".join(p for _, p in held), PART)
            of, a, b = marked([t for t, _ in held], parts, [len(p) // PART.itemsize for _, p in held], length)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (parts["h"][of], parts["c"][of], a.astype(np.int32), b.astype(np.int32))], names=["h", "c", "a", "b"])

        for batch in batches:
            for now, text, part in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if now != key and bytes_ >= index_bytes:
                    yield index()
                    held, bytes_ = [], 0
                key = now
                held.append((text, part))
                bytes_ += len(text)
        if held:
            yield index()

    return pieces.repartition(tasks, "of", "id").sortWithinPartitions("of", "id").mapInArrow(run, "h bigint, c bigint, a int, b int")


def counted_windows(hot: DataFrame, documents: DataFrame, text: str, length: int = LENGTH) -> DataFrame:
    """The same for passages of hot anchors, by the hashes of their windows: a window with two places, or of a passage that occurs twice."""
    wanted = hot.groupBy("row").agg(F.collect_list(F.struct("h", "c", "s", "n", "times")).alias("passages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for whole, lists in zip(_opened(b.column(0)), b.column(1), strict=True):
                for p in lists.as_py():
                    some = whole[p["s"] : p["s"] + p["n"] + length - 1]
                    two = _window_hashes(some, length)
                    n = p["n"]
                    same = lambda v, n=n: pa.array(np.full(n, v, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(two[0]), pa.array(two[1]), same(p["h"]), same(p["c"]), pa.array(np.arange(n, dtype=np.int32)), same(p["times"])], names=["x", "y", "h", "c", "a", "times"])

    windows = _shrunk(documents, text).join(wanted, "row").select("zipped", "passages").mapInArrow(run, "x bigint, y bigint, h bigint, c bigint, a int, times bigint").transform(stored)
    often = windows.groupBy("x", "y").agg(F.sum("times").alias("all")).where("all > 1").drop("all")
    return windows.join(often, ["x", "y"]).select("h", "c", "a", (F.col("a") + 1).alias("b"))


def _window_hashes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for seed in (0, 1):
        power, inverse = _tables(len(data))
        value = mix(data.astype(U) + U(1 + 256 * seed)) if seed else data.astype(U) + U(1)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(value * power[: len(data)], dtype=U)])
        n = len(data) - length + 1
        out.append(mix((sums[length:] - sums[:-length]) * inverse[:n]).view(np.int64))
    return out[0], out[1]


def find_repeats(documents: DataFrame, *, text: str = "text", keep: list[str] | None = None, length: int = LENGTH, gram: int = GRAM, index_bytes: int = INDEX_BYTES, home_bytes: int = HOME_BYTES) -> DataFrame:
    """The kept columns of each document, n_bytes, spans (first byte, end, first byte, ... of its maximal repeated runs) and kept (the other bytes)."""
    small_batches(documents.sparkSession)
    made = ["n_bytes", "spans", "kept"]
    keep = [c for c in (documents.columns if keep is None else keep) if c not in made and (keep is not None or c != text)]
    table = anchored(documents, text, length, gram).transform(stored)
    passages = different(table)
    cool, hot = keyed(passages, length, home_bytes)
    found = pieces(cool, documents, text, length).transform(stored)
    windows = repeated_windows(found, index_bytes, length)
    if hot is not None:
        windows = windows.unionByName(counted_windows(hot, documents, text, length))
    windows = windows.transform(stored)
    discard(found, passages)
    forget(documents.sparkSession)
    runs = _each(table).join(windows, ["h", "c"]).groupBy("row").agg(F.collect_list(F.struct((F.col("s") + F.col("a")).alias("x"), (F.col("s") + F.col("b")).alias("y"))).alias("runs"))
    joined = _shrunk(documents, text, F.struct(*keep).alias("__row")).join(runs, "row", "left").select("__row", "zipped", "runs")
    schema = T.StructType([joined.schema["__row"], *T.StructType.fromDDL("n_bytes bigint, spans array<int>, kept binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, *_ in slices(batches, "zipped", PIECE):
            spans, rest, size = [], [], []
            for whole, runs in zip(_opened(part.column(1)), part.column(2), strict=True):
                size.append(len(whole))
                spans.append(_union(runs, length))
                cut = [0, *spans[-1], len(whole)]
                rest.append(b"".join(whole[a:b].tobytes() for a, b in zip(cut[::2], cut[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(rest, pa.binary())], names=["__row", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, schema).select("__row.*", "n_bytes", "spans", "kept")


def _union(runs: pa.Scalar, length: int) -> list[int]:
    """Bytes covered by the windows from each first to below each end."""
    if not runs.is_valid:
        return []
    x, y = (np.sort(runs.values.field(k).to_numpy()) for k in (0, 1))
    # Runs are disjoint sets of windows, so that firsts and ends sort alike.
    cut = x[1:] > y[:-1] + length - 1
    begin, end = x[np.concatenate([[True], cut])], y[np.concatenate([cut, [True]])] + length - 1
    return np.stack([begin, end], axis=1).ravel().tolist()


def op13_repeats(spark, sf_dir: str) -> DataFrame:
    found = find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    removed = F.expr("aggregate(sequence(0, size(spans) div 2), 0L, (s, i) -> s + coalesce(get(spans, 2 * i + 1) - get(spans, 2 * i), 0))")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.expr("cast(size(spans) div 2 as bigint)").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
