"""Small linear models fitted on the driver from a bounded sample, and the choice of that sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of an id as text, modulo mod; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(mod)), F.lit(0)).cast("int")


def labelled_sample(labels: DataFrame, label: str, mod: int, held_out: int, per_class: int) -> tuple[DataFrame, list[float]]:
    """(doc_id, y) of at most per_class labelled rows of either class, those of the least hashes among rows that aren't held out,
    and what one row of class 0 and of class 1 stands for. Null ids and labels don't take part; of an id's labels the largest counts."""
    rows = labels.where(f"doc_id is not null and {label} in (0, 1)").where(remainder(F.col("doc_id"), mod) != held_out).groupBy("doc_id").agg(F.max(label).alias("y"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picks = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return picks[0].unionByName(picks[1]), [max(1.0, sizes.get(y, 0) / per_class) for y in (0, 1)]


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of a linear hinge-loss classifier, by dual coordinate descent (Hsieh et al. 2008); y is -1 or 1.

    cost bounds each row's dual variable. A row is the indices and values of its features."""
    rng, w, alpha = np.random.default_rng(seed), np.zeros(size), np.zeros(len(y))
    square = np.array([float(v @ v) for v in values]) if len(rows) else np.zeros(0)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            if square[i] == 0:
                continue
            step = (y[i] * float(w[rows[i]] @ values[i]) - 1) / square[i]
            new = min(max(alpha[i] - step, 0.0), cost[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 50) -> np.ndarray:
    """Weights (the last is the intercept, which isn't shrunk) of a weighted logistic regression, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + keep * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(keep + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
