"""Linear probes: regularised logistic regression, its sweep and selection.

Fits are those of ``softmax``, over all partitions.  ``solve`` is the same problem
in one matrix, which tests compare them with.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import softmax

C_GRID = (1e-4, 1e-3, 1e-2, 0.1, 1.0, 10.0)


def solve(x: np.ndarray, y: np.ndarray, classes: int, c: float, rounds: int = 100, tolerance: float = 1e-8) -> np.ndarray:
    """Weights and biases (features + 1, classes) of the softmax model with penalty |w|^2 / (2 C), biases free; Newton steps by conjugate gradients."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    target = np.eye(classes)[y]
    w = np.zeros((z.shape[1], classes))
    ridge = np.full((z.shape[1], 1), softmax.penalty(c, classes))
    ridge[-1] = 1e-9

    def shares(w):
        s = z @ w
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def loss(w):
        return -np.log(np.maximum((shares(w) * target).sum(1), 1e-300)).sum() + 0.5 * (ridge * w * w).sum()

    current = loss(w)
    for _ in range(rounds):
        p = shares(w)
        g = z.T @ (p - target) + ridge * w
        if np.abs(g).max() < tolerance * len(x):
            break
        step, r = np.zeros_like(w), -g
        d, rr = r.copy(), (r * r).sum()
        for _ in range(200):
            u = z @ d
            h = z.T @ (p * (u - (p * u).sum(1, keepdims=True))) + ridge * d
            a = rr / (d * h).sum()
            step += a * d
            r -= a * h
            new = (r * r).sum()
            if new < 1e-18 * len(x) or new < 1e-12 * (g * g).sum():
                break
            d, rr = r + new / rr * d, new
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > current:
            size /= 2
        w = w + size * step
        current = loss(w)
    return w


def probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    s = np.concatenate([x, np.ones((len(x), 1))], 1) @ w
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def moments_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.mean(0), np.maximum(x.std(0, ddof=1) if len(x) > 1 else np.ones(x.shape[1]), 1e-6)


def fit_score(items: DataFrame, keys: list[str], c: float) -> DataFrame:
    """Fit on part fit, score part score; items: keys, row_id, v, label, part: keys, row_id, target, probs."""
    probes = softmax.fit(items.where("part = 'fit'"), keys, [c], classes_of(items, keys))
    return softmax.score(items.where("part = 'score'"), keys, probes).drop("c_value")


def classes_of(items: DataFrame, keys: list[str]) -> dict[tuple, int]:
    """Labels of each unit, counted from 0 (a row for each unit)."""
    rows = items.where("label is not null").groupBy(*keys).agg((F.max("label") + 1).cast("int").alias("classes"))
    return {tuple(r)[:-1]: r["classes"] for r in rows.collect()}


def sweep(items: DataFrame, keys: list[str], grid: tuple[float, ...] = C_GRID) -> DataFrame:
    """Predictions of the val part for each C: items have part train, val, test."""
    probes = softmax.fit(items.where("part = 'train'"), keys, grid, classes_of(items, keys))
    return softmax.score(items.where("part = 'val'"), keys, probes)


def best_c(scores: DataFrame, keys: list[str]) -> DataFrame:
    """c_value of the largest value, the smaller C of equal ones; an undefined value loses."""
    order = (F.coalesce(F.nanvl("value", F.lit(float("-inf"))), F.lit(float("-inf"))).desc(), "c_value")
    return scores.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def best_epoch(history: DataFrame, keys: list[str], patience: int = 10) -> DataFrame:
    """First epoch of the best value seen until training stops: when ``patience`` epochs brought no better one."""
    by = W.partitionBy(*keys).orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    run = history.withColumn("top", F.max("value").over(by))
    run = run.withColumn("best", F.max(F.when((F.col("value") == F.col("top")) & (F.col("value") > F.coalesce(F.max("value").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(float("-inf")))), F.col("epoch"))).over(by))
    stopped = run.withColumn("stop", F.col("epoch") - F.col("best") >= patience)
    first = stopped.groupBy(*keys).agg(F.min(F.when(F.col("stop"), F.col("epoch"))).alias("stop_epoch"), F.max("epoch").alias("last"))
    seen = stopped.join(first, keys).where(F.col("epoch") <= F.coalesce("stop_epoch", "last"))
    return seen.groupBy(*keys).agg(F.max_by("best", "epoch").alias("best_epoch"), F.max_by("top", "epoch").alias("best_value"), F.max("epoch").alias("last_epoch"))
