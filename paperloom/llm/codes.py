"""Vector code compression: product codes whose entries are found by kd-trees and moved by exact integer sums.

A vector's components become integers, floor(4096 * x), and it is cut into ``PARTS`` equal consecutive parts. Each part's
codebook has ``ENTRIES`` entries. In every round the codebooks go to the tasks as kd-trees, a tree for each codebook; a
task searches its batch by branch and bound, and what it sums up for each entry (a row for each entry and component) is
all that is shuffled. A subtree is left out only where its box is farther than the best entry so far: boxes just as far
are visited, so that of equally near entries the one of the lowest index is found.

The vectors are read once a round and never stored: a lost task reads its part of the table again. The driver holds the
codebooks alone, ENTRIES vectors. Errors of a label are summed before they are shuffled and joined back to the rows; labels with over a
thousandth of the rows go by broadcast (there are a thousand at most), others by a shuffle.

Defined cases: a vector that is null, is empty, or has a null or non-finite component is dropped, and so is one whose length isn't that of the
kept row with the least id; a length that ``PARTS`` doesn't divide gives parts of which the first ones are one longer (an empty part has code 0);
fewer than ENTRIES vectors give so many entries; rows that repeat an id are rows of their own, and the first entries go by id, then label, then
components, a null id or label last; components of any size are exact, but an error beyond a long fails; an empty table gives
no rows. Of clashing names the results' stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .sizes import small_batches, stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors that are searched at once.
AT_ONCE = 8192
#: Components up to this size are searched as 64-bit numbers: a squared distance over 1024 of them fits. Others are exact Python numbers.
PLAIN = 2**25


@dataclass
class Node:
    """A box of entries: their least and greatest components, and two halves, or the entries of a leaf by index."""

    low: np.ndarray
    high: np.ndarray
    entries: list[int]
    axis: int = 0
    at: int = 0
    halves: tuple[Node, Node] | None = None


def tree(book: np.ndarray, entries: list[int] | None = None, leaf: int = 2) -> Node:
    """The kd-tree over a codebook, halved at the median of its widest component."""
    entries = list(range(len(book))) if entries is None else entries
    low, high = book[entries].min(axis=0), book[entries].max(axis=0)
    node = Node(low, high, entries)
    if len(entries) > leaf and len(low) and (high - low).max() > 0:
        node.axis = int(np.argmax(high - low))
        order = sorted(entries, key=lambda e: (book[e][node.axis], e))
        half = len(order) // 2
        node.at = book[order[half]][node.axis]
        node.halves = (tree(book, order[:half], leaf), tree(book, order[half:], leaf))
    return node


def nearest(node: Node, book: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index and the squared distance of the entry nearest to each row of x, of equally near ones the lowest."""
    best, far = np.full(len(x), -1, np.int64), np.zeros(len(x), x.dtype)

    def visit(node: Node, rows: np.ndarray) -> None:
        out = np.maximum(node.low - x[rows], 0) + np.maximum(x[rows] - node.high, 0)
        rows = rows[(best[rows] < 0) | ((out * out).sum(axis=1) <= far[rows])]
        if not len(rows):
            return
        if node.halves is None:
            for e in node.entries:
                d = x[rows] - book[e]
                d = (d * d).sum(axis=1)
                better = (best[rows] < 0) | (d < far[rows]) | ((d == far[rows]) & (e < best[rows]))
                best[rows[better]], far[rows[better]] = e, d[better]
            return
        left = x[rows, node.axis] < node.at
        for first, then, part in ((*node.halves, rows[left]), (*node.halves[::-1], rows[~left])):
            if len(part):
                visit(first, part)
                visit(then, part)

    visit(node, np.arange(len(x)))
    return best, far


def _parts(width: int, parts: int) -> list[tuple[int, int]]:
    sizes = [width // parts + (k < width % parts) for k in range(parts)]
    return [(sum(sizes[:k]), sum(sizes[: k + 1])) for k in range(parts)]


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit numbers if all are small, else as Python's. The scale is a power of two, so that the product is exact."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    if not len(y) or np.abs(y).max() < PLAIN:
        return y.astype(np.int64)
    exact = [int(a) if np.isfinite(a) else int(b) * scale for a, b in zip(y.ravel().tolist(), x.ravel().tolist(), strict=True)]
    return np.array(exact, dtype=object).reshape(x.shape)


def _vectors(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of batches and their vectors, all of one width and finite, as integers. The last column holds the vectors."""
    for batch in batches:
        for low in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(low, AT_ONCE)
            values = part.column(part.num_columns - 1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            yield part, _integers(values.reshape(part.num_rows, width), scale)


def _assigned(x: np.ndarray, books: list[np.ndarray], trees: list[Node], cuts: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for book, root, (a, b) in zip(books, trees, cuts, strict=True):
        part = x[:, a:b]
        if part.dtype != book.dtype:
            part, book = part.astype(object), book.astype(object)
        out.append(nearest(root, book, part))
    return out


def kept_vectors(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector has components, all of them finite numbers."""
    finite = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.coalesce(finite & (F.size(vector) > 0), F.lit(False)))


def _book(rows: list[list[int]]) -> np.ndarray:
    wide = any(abs(v) >= PLAIN for r in rows for v in r)
    return np.array(rows, dtype=object if wide else np.int64).reshape(len(rows), -1)


def fit(kept: DataFrame, first: list[list[float]], *, vector: str, scale: int = SCALE, parts: int = PARTS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Each part's codebook after some rounds that began with the first vectors."""
    width = len(first[0])
    cuts = _parts(width, parts)
    whole = _integers(np.array(first, dtype=np.float64), scale)
    books = [_book(whole[:, a:b].tolist()) for a, b in cuts]
    context = kept.sparkSession.sparkContext

    def sums(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books, trees = shared.value
            total = {}
            for _, x in _vectors(batches, width, scale):
                for k, ((a, b), (at, _)) in enumerate(zip(cuts, _assigned(x, books, trees, cuts), strict=True)):
                    for e in np.unique(at).tolist():
                        rows = x[at == e][:, a:b]
                        n, s = total.get((k, e), (0, [0] * (b - a)))
                        total[k, e] = n + len(rows), [u + int(v) for u, v in zip(s, rows.sum(axis=0).tolist(), strict=True)]
            flat = [(k, e, i, n, Decimal(v)) for (k, e), (n, s) in total.items() for i, v in enumerate(s)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True) if flat else [[]] * 5, kinds, strict=True)], names=["part", "entry", "place", "n", "total"])

        return kept.select(vector).mapInArrow(run, "part int, entry int, place int, n bigint, total decimal(38,0)")

    for _ in range(rounds):
        shared = context.broadcast((books, [tree(b) for b in books]))
        got = sums(shared).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        new = [b.tolist() for b in books]
        for r in got:
            new[r["part"]][r["entry"]][r["place"]] = int(r["total"]) // r["n"]
        books = [_book(b) if b and b[0] else old for b, old in zip(new, books, strict=True)]
        shared.unpersist()
    return books


def encode(kept: DataFrame, books: list[np.ndarray], *, vector: str, keep: list[str], scale: int = SCALE) -> DataFrame:
    """The kept columns, the code (two hex digits for each part) and the squared error of each row."""
    cuts = _parts(sum(b.shape[1] for b in books), len(books))
    width = cuts[-1][1]
    shared = kept.sparkSession.sparkContext.broadcast((books, [tree(b) for b in books]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = shared.value
        for part, x in _vectors(batches, width, scale):
            found = _assigned(x, books, trees, cuts)
            digits = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            code = [bytes(r).hex() for r in digits]
            error = sum((d.astype(object) if d.dtype == object else d) for _, d in found)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(code, pa.string()), pa.array(error.tolist(), pa.int64())], names=[*keep, "code", "error"])

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema)
    return kept.select(*keep, vector).mapInArrow(run, f"{schema}, code string, error bigint")


def compress(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(key, label, code, error, label_error, codebooks_sha256) of each kept row."""
    small_batches(vectors.sparkSession)
    kept = kept_vectors(vectors.select(key, label, vector), vector)
    order = [F.col(key).asc_nulls_last(), F.col(label).asc_nulls_last(), F.col(vector)]
    least = kept.orderBy(*order).limit(1).first()
    if least is None:
        sha = hashlib.sha256(b"").hexdigest()
        return kept.select(key, label, F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"), F.lit(sha).alias("codebooks_sha256"))
    kept = kept.where(F.size(vector) == len(least[vector]))
    first = [r[vector] for r in kept.orderBy(*order).limit(entries).collect()]
    books = fit(kept, first, vector=vector, scale=scale, parts=parts, rounds=rounds)
    sha = hashlib.sha256(",".join(str(int(v)) for b in books for r in b.tolist() for v in r).encode()).hexdigest()
    coded = encode(kept, books, vector=vector, keep=[key, label], scale=scale).transform(stored)
    return _with_label_error(coded, label).select(key, label, "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


#: A label with more than this share of the rows is joined by broadcast.
OFTEN = 1000


def _with_label_error(coded: DataFrame, label: str) -> DataFrame:
    sums = coded.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("__n")).transform(stored)
    rows = sums.agg(F.sum("__n")).first()[0] or 0
    same: Column = F.col(label).eqNullSafe(F.col("__label"))
    often = sums.where(F.col("__n") * OFTEN > rows).withColumn("__often", F.lit(True))
    rest = sums.where(F.col("__n") * OFTEN <= rows)
    joined = coded.join(F.broadcast(often), same, "left")
    if rest.isEmpty():
        return joined
    hot = joined.where("__often")
    cold = joined.where("__often is null").select(*coded.columns)
    return hot.select(*coded.columns, "label_error").unionByName(cold.join(rest, same).select(*coded.columns, "label_error"))


def op11_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The same in SQL: a table for each round's codebooks. A part's place and its distances are list functions."""
    step = [
        f"""v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), w AS MATERIALIZED (
  SELECT rid, vec_id, label, p, list_transform(embedding[1 + p * len(embedding) // {PARTS} : (p + 1) * len(embedding) // {PARTS}], lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x
  FROM v, range({PARTS}) AS t(p)
), first AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS e FROM v QUALIFY e < {ENTRIES}),
b0 AS MATERIALIZED (SELECT p, e, x AS c FROM w JOIN first USING (rid))"""
    ]
    for k in range(ROUNDS + 1):
        distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        step.append(f"""a{k} AS MATERIALIZED (
  SELECT rid, w.p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (SELECT rid, w.p, e, {distance} AS d FROM w JOIN b{k} USING (p)) w GROUP BY rid, w.p
)""")
        if k < ROUNDS:
            step.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b{k}.p, b{k}.e, coalesce(m.c, b{k}.c) AS c FROM b{k} LEFT JOIN (
    SELECT p, e, list(s ORDER BY i) AS c FROM (
      SELECT p, e, i, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS s
      FROM (SELECT a.p, a.e, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{k} a JOIN w USING (rid, p)) GROUP BY p, e, i
    ) GROUP BY p, e
  ) m USING (p, e)
)""")
    return f"""WITH {", ".join(step)},
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid),
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN v USING (rid), sha"""


SQL = _sql()
