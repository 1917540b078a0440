"""Best-fit packing by patterns and non-negative least squares (Krell et al. 2021).

Documents become token ids with an end id, and pieces of at most a sequence's length. Only the histogram of
piece lengths, which has one count for each length whatever the input, goes to the driver. There, patterns of
up to three lengths that fill a sequence are fitted to the histogram by non-negative least squares and their
repeat counts rounded, some times over; the pieces that are left are packed by best fit in descending order, on the
histogram too. The result is a table of rank intervals for each length: the pieces of one length are ranked
(see ranks.py), and a piece's rank gives its sequence and its place there. Text is read once and tokenised
once; the pieces, without their ids, are stored in the checkpoint folder.

Ids are those that ``tokenizers`` gives by its file, without a switch; they are made by ``tiktoken`` from the same vocabulary's ranks, which
is four times as fast and was found equal for every code point and on all test tables. The file's added tokens, which the ranks don't have, are
read from it: such a token's string in a text is that token's one id.

Defined cases: a null or empty text is its end id alone; equal and repeated documents are packed one by one; no
documents give no pieces; pieces of equal length are told apart by a hash of id, piece and checksum; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ranks import ranked
from .sizes import small_batches, stored

LENGTH, END = 2048, 0
VOCABULARY, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


@lru_cache(maxsize=2)
def _encoding(path: str | None, tokenizer: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(tokenizer or public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def encode(text: str | None, path: str | None = None, tokenizer: str | None = None) -> np.ndarray:
    """A document's ids and the end id. path: the vocabulary's ranks, tokenizer: the file with its added tokens."""
    return np.append(_encoding(path, tokenizer).encode_to_numpy(text, allowed_special="all") if text else np.zeros(0, np.uint32), np.uint32(END)).astype("<u4")


def cut(n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pieces of n ids; only the first is shorter than the length."""
    first = (n - 1) % length + 1
    start = np.concatenate([[0], np.arange(first, n, length)])
    return start, np.diff(np.append(start, n))


def pieces(documents: DataFrame, length: int = LENGTH, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece, and its ids if they are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows, ids_of = [], []
                part = batch.slice(low, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = encode(text.as_py(), path)
                    for k, (a, n) in enumerate(zip(*(x.tolist() for x in cut(len(ids), length)), strict=True)):
                        own = ids[a : a + n]
                        rows.append((doc, k, a, n, zlib.crc32(own)))
                        if with_ids:
                            ids_of.append(own.astype(np.int32))
                arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(ids_of, pa.list_(pa.int32()))] if with_ids else []), names=names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def patterns(lengths: np.ndarray, full: int) -> np.ndarray:
    """All one to three of the lengths that make up the full length, as columns of three; 0 stands for none."""
    have = np.zeros(full + 1, bool)
    have[lengths] = True
    out = [np.array([[full], [0], [0]])] if have[full] else []
    a = lengths[lengths * 2 <= full]
    out.append(np.stack([a, full - a, np.zeros_like(a)])[:, have[full - a]])
    for x in lengths[lengths * 3 <= full].tolist():
        y = lengths[(lengths >= x) & (lengths * 2 <= full - x)]
        y = y[have[full - x - y]]
        out.append(np.stack([np.full_like(y, x), y, full - x - y]))
    return np.concatenate(out, axis=1).astype(np.int64)


def fit_counts(p: np.ndarray, histogram: np.ndarray, rounds: int = 40, enter: int = 128) -> np.ndarray:
    """Repeat counts of the patterns, by non-negative least squares: an active set that several patterns enter at a time.

    Those of largest gradient enter that share no length; the set is solved and its negative ones leave until none is."""
    n, h = p.shape[1], histogram.astype(float).copy()
    h[0] = 0
    x, active = np.zeros(n), np.zeros(0, np.int64)
    for _ in range(rounds):
        fitted = sum(np.bincount(row, weights=x, minlength=len(h)) for row in p)
        rest = h - fitted
        rest[0] = 0
        gradient = rest[p[0]] + rest[p[1]] + rest[p[2]]
        gradient[active] = 0
        best = np.argsort(-gradient)[: 40 * enter]
        used, new = np.zeros(len(h), bool), []
        for i in best[gradient[best] > 0.5].tolist():
            if not used[p[:, i]].any():
                used[p[:, i]] = True
                used[0] = False
                new.append(i)
        if not new or np.abs(rest).sum() < 1e-3 * h.sum():
            break
        active = np.concatenate([active, new[:enter]])
        while len(active):
            columns = np.zeros((len(h), len(active)), np.float32)
            for row in p[:, active]:
                np.add.at(columns, (row, np.arange(len(active))), 1)
            columns[0] = 0
            z = np.linalg.solve(columns.T @ columns + 1e-3 * np.eye(len(active), dtype=np.float32), columns.T @ h.astype(np.float32))
            if z.min() > 0:
                break
            active = active[z > 0]
        x = np.zeros(n)
        if len(active):
            x[active] = z
    return x


def best_fit(histogram: np.ndarray, full: int) -> list[tuple[list[int], int]]:
    """Sequences of the histogram's pieces, longest first, each in the fullest sequence with room: (lengths, sequences of that kind)."""
    room: dict[int, list[tuple[list[int], int]]] = {}
    for length in range(full, 0, -1):
        n = int(histogram[length])
        while n:
            r = next((r for r in range(length, full) if room.get(r)), None)
            if r is None:
                each = min(full // length, n)
                k = n // each
                room.setdefault(full - each * length, []).append(([length] * each, k))
                n -= each * k
            else:
                held, k = room[r].pop()
                each = min(r // length, n)
                take = min(k, n // each)
                if k > take:
                    room[r].append((held, k - take))
                room.setdefault(r - each * length, []).append((held + [length] * each, take))
                n -= each * take
    return [group for groups in room.values() for group in groups]


#: Times that patterns are fitted to what the rounds before have left.
FITS = 4


def plan(histogram: np.ndarray, full: int = LENGTH) -> list[tuple[list[int], int]]:
    """The kinds of sequence, as the lengths in each and how many there are: patterns with their counts rounded, as far as there are pieces,
    fitted again to what is left until no count reaches a half, and best fit for the rest."""
    left, out = histogram.astype(np.int64).copy(), []
    for _ in range(FITS):
        lengths = np.flatnonzero(left)
        p = patterns(lengths, full) if len(lengths) else np.zeros((3, 0), np.int64)
        x = fit_counts(p, left) if p.shape[1] else np.zeros(0)
        before = int(left.sum())
        for i in np.argsort(-x, kind="stable").tolist():
            if x[i] < 0.5:
                break
            kind, need = np.unique(p[:, i][p[:, i] > 0], return_counts=True)
            n = min(int(x[i] + 0.5), int((left[kind] // need).min()))
            if n:
                left[kind] -= n * need
                out.append((p[:, i][p[:, i] > 0].tolist(), n))
        if int(left.sum()) == before:
            break
    return out + best_fit(left, full)


def intervals(kinds: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each slot of each kind: length << 40 | first rank, sorted; the sequence of that rank; and the slot's offset."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in kinds:
        offset = 0
        for length in lengths:
            rank = next_rank.get(length, 0)
            rows.append((length << 40 | rank, sequence, offset))
            next_rank[length] = rank + n
            offset += length
        sequence += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def pack(documents: DataFrame, *, length: int = LENGTH, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset. length is below 2**20."""
    small_batches(documents.sparkSession)
    made = pieces(documents, length, path, with_ids).transform(stored)
    histogram = np.zeros(length + 1, np.int64)
    for r in made.groupBy("length").agg(F.count("*").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    shared = documents.sparkSession.sparkContext.broadcast(intervals(plan(histogram, length)))
    even = (F.xxhash64("doc_id", "piece", "ids_crc32").cast("double") + 2.0**63) / 2.0**64 * (1 - 2.0**-52)
    placed = ranked(made, ["length"], even, ["doc_id", "piece", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sequence, offset = shared.value
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy()
            at = batch.column(3).to_numpy() << 40 | rank
            i = np.searchsorted(key, at, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence[i] + (at - key[i])), pa.array(offset[i])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema)
    return placed.select(*made.columns, F.col("rank").cast("bigint").alias("rank")).mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
