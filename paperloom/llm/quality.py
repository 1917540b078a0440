"""Quality classifier: naive Bayes support vectors (Wang and Manning 2012).

A text's features are indicators of n-grams, hashed into 2**18 places: one and two words, one to three
token shapes (case, digits, first and last symbol, equal to the token before), and the rounded shares of
each shape and of repeated words. Each place is scaled by its log-count ratio between the classes, rows are
brought to length one, and a linear hinge-loss model is fitted by dual coordinate descent. A sigmoid fitted
on margins of rows that a fold's model hasn't seen makes them a probability.

(Shapes and shares are features beside the method's n-grams: what makes a text poor here is mostly how it is set, and not
its words.) The model is fitted on the driver from at most ``per_class`` labelled rows of each class; every document is
scored whole, where it lies, without a shuffle.

Defined cases: a null or empty text has no features and gets the model's intercept; without rows of both
classes every score is the share of class 1 (one half if there are no rows); repeated documents are scored
alike; a text of any length is taken whole; an empty table gives no rows; other columns are kept, but for one named score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .linear import dual_descent, labelled_sample, logistic, remainder, sigmoid
from .sizes import small_batches
from .words import U, WORD, grams, mix, slices, words_of

BITS = 18
PER_CLASS = 3000
THRESHOLD = 0.7

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], (~_SPACE[data]).astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _shapes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token between white space: its shape, its kind (one of eight), and whether it equals the token before."""
    start, end = _tokens(data)
    if not len(start):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, bool)
    total = lambda t: np.add.reduceat(t[data], start)
    upper, digit, word = total(_UPPER), total(_DIGIT), total(WORD.astype(np.int64))
    first, last = data[start].astype(np.int64), data[end - 1].astype(np.int64)
    case = np.where(upper == 0, 0, np.where((upper == 1) & (_UPPER[first] == 1), 1, 2))
    mark = np.where(word == 0, 2, np.where(digit > 0, 1, 0))
    size = end - start
    h = np.add.reduceat(mix(data.astype(U) + U(257) * (np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))).astype(U)) * (~_SPACE[data]).astype(U), start)
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (size[1:] == size[:-1])])
    symbol = lambda b: np.where(WORD[b], 0, b)
    kind = case + 3 * (mark == 2) + 4 * (symbol(last) > 0) * (mark != 2)
    return mix(((((case * 3 + mark) * 2 + same) * 256 + symbol(first)) * 256 + symbol(last)).astype(U)), np.minimum(kind, 7), same


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The places that each text sets, each once."""
    shift = U(64 - BITS)
    w = words_of(data, offsets)
    one, two = (grams(w.hash, 1) >> shift).astype(np.int32), (grams(w.hash, 2) >> shift).astype(np.int32)
    seen = np.zeros(1 << BITS, dtype=bool)
    for i in range(len(offsets) - 1):
        a, b = w.first[i], w.first[i + 1]
        seen[one[a:b]] = True
        seen[two[a : max(a, b - 1)]] = True
        shape, kind, same = _shapes(data[offsets[i] : offsets[i + 1]])
        if n := len(shape):
            for k in (1, 2, 3):
                seen[(mix(grams(shape, k)[: max(0, n - k + 1)] + U(k << 40)) >> shift).astype(np.int64)] = True
            shares = np.append(np.bincount(kind, minlength=8), same.sum()) / n
            part = one[a:b]
            distinct = len(np.unique(part)) / len(part) if len(part) else 1.0
            rounded = np.append(np.ceil(10 * shares), [np.floor(10 * distinct), np.floor(np.log2(n + 1))]).astype(U)
            seen[(mix(rounded * U(64) + np.arange(len(rounded)).astype(U) + U(3 << 50)) >> shift).astype(np.int64)] = True
        places = np.flatnonzero(seen)
        seen[places] = False
        yield places


def fit(rows: list[np.ndarray], y: np.ndarray, stands_for: list[float]) -> dict:
    """scaled: each place's weight, its ratio taken in; square: its ratio squared; slope and shift of the sigmoid."""
    size = 1 << BITS
    weight = np.where(y == 1, stands_for[1], stands_for[0]).astype(float)
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.5
        return {"scaled": np.zeros(size), "square": np.ones(size), "slope": 1.0, "shift": float(np.log(max(rate, 0.01) / max(1 - rate, 0.01)))}

    def model(pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.ones((2, size))
        for i in pick:
            counts[int(y[i])][rows[i]] += 1
        p, q = counts[1] / counts[1].sum(), counts[0] / counts[0].sum()
        ratio = np.log(p / q)
        values = [ratio[rows[i]] / max(np.linalg.norm(ratio[rows[i]]), 1e-12) for i in pick]
        each = [len(pick) / max(1, 2 * (y[pick] == k).sum()) for k in (0, 1)]
        w = dual_descent([rows[i] for i in pick], values, np.where(y[pick] == 1, 1, -1), size, np.where(y[pick] == 1, each[1], each[0]))
        return w * ratio, ratio**2

    folds, margins = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        scaled, square = model(np.flatnonzero(folds != k))
        for i in np.flatnonzero(folds == k):
            margins[i] = margin(rows[i], scaled, square)
    slope, shift = logistic(margins[:, None], y.astype(float), weight, 1e-3)
    scaled, square = model(np.arange(len(y)))
    return {"scaled": scaled, "square": square, "slope": float(slope), "shift": float(shift)}


def margin(places: np.ndarray, scaled: np.ndarray, square: np.ndarray) -> float:
    return float(scaled[places].sum() / max(np.sqrt(square[places].sum()), 1e-12)) if len(places) else 0.0


def train(documents: DataFrame, labels: DataFrame, *, label: str = "quality", mod: int = 4, held_out: int = 2, per_class: int = PER_CLASS) -> dict:
    small_batches(documents.sparkSession)
    sample, stands_for = labelled_sample(labels, label, mod, held_out, per_class)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            places = [p.astype(np.int32).tobytes() for p in features(data, offsets)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), pa.array(places, pa.binary())], names=["doc_id", "y", "places"])

    # A document's first row of an id counts, so that repeated rows can't make the sample larger.
    got = texts.mapInArrow(run, "doc_id bigint, y int, places binary").groupBy("doc_id").agg(F.min(F.struct("y", "places")).alias("x")).select("doc_id", "x.*")
    table = got.toArrow().sort_by("doc_id")
    return fit([np.frombuffer(p, np.int32) for p in table.column("places").to_pylist()], np.array(table.column("y").to_pylist(), dtype=np.int64), stands_for)


def score(documents: DataFrame, model: dict, *, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The kept columns of each document and score, 0 to 1."""
    keep = [c for c in (documents.columns if keep is None else keep) if c != "score"]
    kept = documents.select(*keep)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema)
    shared = documents.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) if isinstance(v, np.ndarray) else v for k, v in model.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, data, offsets in slices(batches, "__text"):
            margins = np.array([margin(p, m["scaled"], m["square"]) for p in features(data, offsets)])
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(sigmoid(m["slope"] * margins + m["shift"]), pa.float64())], names=[*keep, "score"])

    return documents.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{schema}, score double" if schema else "score double")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(documents, train(documents, labels), keep=["doc_id"])
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
