"""Exact vector retrieval, by pruned cells where there are many queries, and the prompts that are built from what it finds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import ANSWER_PROMPT, SETTINGS
from ..functions.stored import stored
from ..functions.text import fill


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def top_k(chunks: DataFrame, query: list[float], k: int | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows most like one query vector, and score. Each task keeps its own k; only these meet."""
    score = dot(F.col(vector), F.array(*(F.lit(float(x)) for x in query)))
    return chunks.withColumn("score", score).orderBy(F.desc("score"), key).limit(k or SETTINGS.retrieved)


#: Rows of a block of vectors; blocks of a part of a cell, which one task works on at a time; most rows that cells are fitted on, for each cell.
BLOCK_ROWS, PART_BLOCKS, SAMPLED = 1024, 64, 256
_BLOCK = "cell int, part int, n int, ids binary, vectors binary, far double"


@dataclass(frozen=True)
class Cells:
    """Vectors dealt to the nearest of some centres and stored in blocks: cell, part (of a large cell), n, ids, vectors and far, the greatest
    distance from the centre in the block. rows and radius: each cell's."""

    blocks: DataFrame
    centres: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    parts: np.ndarray


def _numbers(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows whose vector has components, all of them finite."""
    good = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(F.coalesce(good & (F.size(vector) > 0), F.lit(False))).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0))


def _packed(rows: DataFrame, by: tuple[str, str]) -> DataFrame:
    """Blocks of the rows (two keys, id, v, far), of one pair of keys each. Rows come sorted by the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, second = (b.column(k).to_numpy() for k in (0, 1))
            cut = np.flatnonzero((first[1:] != first[:-1]) | (second[1:] != second[:-1])) + 1
            edges = [0, *cut.tolist(), b.num_rows]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                for at in range(low, high, BLOCK_ROWS):
                    part = b.slice(at, min(BLOCK_ROWS, high - at))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([first[at]], pa.int32()), pa.array([second[at]], pa.int32()), pa.array([part.num_rows], pa.int32()), pa.array([part.column(2).to_numpy().tobytes()]),
                        pa.array([np.ascontiguousarray(_matrix(part.column(3))).tobytes()]), pa.array([part.column(4).to_numpy().max()]),
                    ], names=["cell", "part", "n", "ids", "vectors", "far"])

    return rows.select(*by, "id", "v", "far").mapInArrow(run, _BLOCK)


def fit_centres(vectors: DataFrame, cells: int, sampled: int = SAMPLED, seed: int = 7) -> np.ndarray:
    """Centres of k-means over at most ``cells * sampled`` of the vectors (id, v), those of the least hashes."""
    sample = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(cells * sampled)
    if cells == 1:
        width = vectors.select(F.size("v").alias("n")).first()
        return np.zeros((1, width["n"] if width else 1))
    model = KMeans(k=cells, seed=seed, maxIter=12, featuresCol="f").fit(sample.select(array_to_vector("v").alias("f")))
    return np.array(model.clusterCenters())


def build_cells(chunks: DataFrame, *, cells: int | None = None, vector: str = "embedding", key: str = "vec_id", sampled: int = SAMPLED) -> Cells:
    """Every row in a cell. cells: about the root of the rows if not said, 4096 at most. A cell's rows are dealt to as many parts as they need, so that a
    cell with a third of all rows is many tasks. The blocks go to the checkpoint folder."""
    vectors = _numbers(chunks, key, vector)
    count = vectors.count()
    cells = max(1, min(cells or int(count**0.5), 4096, count))
    centres = fit_centres(vectors, cells, sampled)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            d = _distances(x, shared.value)
            cell = d.argmin(axis=1)
            # The distance itself, as the product's is short of digits where it is small.
            far = np.sqrt(((x - shared.value[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column(0), b.column(1), pa.array(far)], names=["cell", "id", "v", "far"])

    placed = vectors.mapInArrow(run, "cell int, id bigint, v array<double>, far double")
    counted = {r["cell"]: (r["n"], r["far"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    rows = np.array([counted.get(c, (0, 0.0))[0] for c in range(len(centres))], np.int64)
    radius = np.array([counted.get(c, (0, 0.0))[1] for c in range(len(centres))])
    parts = np.maximum(1, -(-rows // (BLOCK_ROWS * PART_BLOCKS)))
    several = F.get(F.array(*(F.lit(int(n)) for n in parts)), F.col("cell")) if parts.max() > 1 else F.lit(1)
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("id"), several).cast("int"))
    return Cells(stored(_packed(dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "id"), ("cell", "part"))), centres, rows, radius, parts)


def _best(query: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k entries of highest score, then least key."""
    order = np.lexsort([key, -score, query])
    query, key, score = query[order], key[order], score[order]
    first = np.maximum.accumulate(np.where(np.concatenate([[True], query[1:] != query[:-1]]), np.arange(len(query)), 0)) if len(query) else query
    keep = np.arange(len(query)) - first < k
    return query[keep], key[keep], score[keep]


def _bounds(queries: DataFrame, index: Cells, k: int) -> DataFrame:
    """(query, q, cell, bound, first) of each query and cell with rows: no row of the cell scores above bound, as a row is at most the cell's radius from
    its centre; first: whether the cell is among the likeliest that hold k rows together."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, index.rows, index.radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, rows, radius = shared.value
        there = np.flatnonzero(rows)
        for b in batches if len(there) else ():
            q = _matrix(b.column(1))
            near = q @ centres[there].T
            length = np.sqrt((q * q).sum(axis=1))
            # Sums of floats are only so exact.
            slack = 1e-9 * (1 + length[:, None] * (np.sqrt((centres[there] ** 2).sum(axis=1)) + radius[there]))
            bound = near + length[:, None] * radius[there] + slack
            order = np.argsort(-near, axis=1, kind="stable")
            held = np.cumsum(rows[there][order], axis=1) - rows[there][order]
            first = np.zeros(near.shape, bool)
            np.put_along_axis(first, order, held < k, axis=1)
            n, m = near.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), m)), b.column(1).take(pa.array(np.repeat(np.arange(n), m))), pa.array(np.tile(there, n).astype(np.int32)), pa.array(bound.ravel()), pa.array(first.ravel())], names=["query", "v", "cell", "bound", "first"])

    return queries.select("id", "v").mapInArrow(run, "query bigint, v array<double>, cell int, bound double, first boolean")


def _scored(wanted: DataFrame, index: Cells, k: int) -> DataFrame:
    """(query, id, score): of each query (query, v, cell) the best k in each part of each of its cells."""
    parts = F.get(F.array(*(F.lit(int(n)) for n in index.parts)), F.col("cell")) if index.parts.max() > 1 else F.lit(1)
    each = wanted.select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("query").alias("id"), "v", F.lit(0.0).alias("far"))
    asked = _packed(each.repartition("cell", "part").sortWithinPartitions("cell", "part", "id"), ("cell", "part"))
    both = index.blocks.select("cell", "part", "n", "ids", "vectors").join(asked.select("cell", "part", F.col("n").alias("m"), F.col("ids").alias("queries"), F.col("vectors").alias("q")), ["cell", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, ids, x, m, queries, q in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                ids, queries, x, q = np.frombuffer(ids, np.int64), np.frombuffer(queries, np.int64), np.frombuffer(x).reshape(n, -1), np.frombuffer(q).reshape(m, -1)
                # Rounded, so that equal vectors have equal scores wherever they stand in a product.
                score = np.round(q @ x.T, 12)
                at = np.argpartition(-score, k - 1, axis=1)[:, k - 1] if n > k else None
                least = score[np.arange(m), at][:, None] if at is not None else -np.inf
                i, j = np.nonzero(score >= least)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(queries[i], ids[j], score[i, j], k)], names=["query", "id", "score"])

    return both.select("n", "ids", "vectors", "m", "queries", "q").mapInArrow(run, "query bigint, id bigint, score double")


def _top(scored: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Found:
    """rows: (query_id, key, score, rank). read: (query_id, cells, rows, share), what of the table each query was held against."""

    rows: DataFrame
    read: DataFrame


def search(index: Cells, queries: DataFrame, k: int | None = None, key: str = "vec_id") -> Found:
    """The k best rows of each of the queries (query_id, v), exactly, by pruned cells.

    Each query is first held against the likeliest cells that have k rows; its k-th score then rules out the cells that can't reach it,
    and the rest is read. Queries are joined to blocks by cell, as a table: nothing of them goes through the driver."""
    k = k or SETTINGS.retrieved
    bounds = stored(_bounds(_numbers(queries, "query_id", "v"), index, k))
    first = stored(_top(_scored(bounds.where("first"), index, k), k))
    kth = first.where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
    rest = stored(bounds.where("not first").join(kth, "query", "left").where("kth is null or bound >= kth").select("query", "v", "cell"))
    found = _top(first.drop("rank").unionByName(_scored(rest, index, k)), k)
    read = bounds.where("first").select("query", "cell").unionByName(rest.select("query", "cell"))
    rows, all_ = F.get(F.array(*(F.lit(int(n)) for n in index.rows)), F.col("cell")), max(1, int(index.rows.sum()))
    read = read.groupBy("query").agg(F.count("*").alias("cells"), F.sum(rows).alias("rows"))
    return Found(found.select(F.col("query").alias("query_id"), F.col("id").alias(key), "score", "rank"), read.select(F.col("query").alias("query_id"), "cells", "rows", (F.col("rows") / all_).alias("share")))


def top_k_each(chunks: DataFrame, queries: DataFrame, k: int | None = None, vector: str = "embedding", key: str = "vec_id", cells: int | None = 1) -> DataFrame:
    """(query_id, key, score, rank): the k most like rows of each of the queries (query_id, v); ties go to the least key. With one cell, every query is
    held against every row; with more, or None for as many as suit the table, cells are pruned. Rows and queries without a vector of finite numbers don't take part."""
    return search(build_cells(chunks, cells=cells, vector=vector, key=key), queries, k, key).rows


def answer_prompt(passages: DataFrame, question: str, text: str = "text", rank: str = "rank") -> DataFrame:
    """One row: the prompt with the retrieved passages, in order, parted by blank lines."""
    context = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, text))), lambda p: p[text]), "\n\n")
    return passages.agg(fill(ANSWER_PROMPT, context=context, question=F.lit(question)).alias("prompt"))
