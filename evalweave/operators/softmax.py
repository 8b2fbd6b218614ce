"""Softmax regression fitted by passes over all partitions.

Losses and gradients are sums over rows, so each pass sends the present weights of
all units and all values of C to the tasks, which add up their rows in Arrow batches.
A unit's rows are read once a pass for all its values of C, and no task holds a unit.
The driver keeps weights alone: it moves each problem by L-BFGS, whose first guess
of the curvature is the unit's Gram matrix (the curvature at weights 0), and drops
those that are done.  The step is halved where the loss doesn't fall.

Loss: the sum of -log p(label) and |w|^2 / (2 C); biases are free.  With two classes
the penalty is that of one logit.  Vectors are standardised by the fitting rows.
A null vector, label or key is an error of the caller's: such rows are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written

#: Rows whose products are held at a time.
ROWS = 2048
MEMORY = 20
FEW = 16
MOST_PASSES = 5000
TOLERANCE = 1e-10


@dataclass
class Probe:
    """A unit's moments and, by C, its weights (features + 1, classes) with the passes that they took."""

    mean: np.ndarray
    sd: np.ndarray
    weights: dict[float, np.ndarray]
    passes: dict[float, int]


def probabilities(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    s = z @ w[:-1] + w[-1]
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def penalty(c: float, classes: int) -> float:
    """Two columns share one logit's penalty."""
    return (2 if classes == 2 else 1) / c


def matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def summed(rows: DataFrame, part: Callable[[int, np.ndarray, np.ndarray], dict[int, np.ndarray]], tasks: int) -> dict[tuple[int, int], np.ndarray]:
    """Sums over all rows (unit, label, v) of what ``part`` gives for slices of one unit: arrays by number.

    Each task sends one row for each unit and number; they are added up by the executors, or by the
    driver where there are ``FEW`` tasks at most.
    """
    schema = pa.schema([("unit", pa.int32()), ("part", pa.int32()), ("total", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            unit, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for u in np.unique(unit):
                at = np.flatnonzero(unit == u)
                for first in range(0, len(at), ROWS):
                    some = at[first : first + ROWS]
                    for k, x in part(int(u), matrix(batch.column(2).take(pa.array(some))), label[some]).items():
                        held[int(u), k] = held[int(u), k] + x if (int(u), k) in held else x
        for (u, k), x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([u], pa.int32()), pa.array([k], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))], schema=schema)

    parts = rows.mapInArrow(run, "unit int, part int, total array<double>")
    if tasks <= FEW:
        out: dict[tuple[int, int], np.ndarray] = {}
        for r in parts.collect():
            key, x = (r["unit"], r["part"]), np.array(r["total"])
            out[key] = out[key] + x if key in out else x
        return out
    parts = parts.select("unit", "part", array_to_vector("total").alias("total"))
    # a row for each unit and value of C, as wide as its weights
    found = parts.groupBy("unit", "part").agg(vector_to_array(Summarizer.sum(F.col("total"))).alias("total")).collect()
    return {(r["unit"], r["part"]): np.array(r["total"]) for r in found}


class Descent:
    """L-BFGS for one unit and one C; ``trial`` are the weights that the next pass looks at."""

    def __init__(self, shape: tuple[int, int], gram: np.ndarray, rows: int, c: float):
        self.ridge = np.full((shape[0], 1), penalty(c, shape[1]))
        self.ridge[-1] = 0
        curve = gram / shape[1] + np.diag(self.ridge[:, 0])
        curve[-1, -1] += 1e-9
        self.inverse = np.linalg.inv(curve + 1e-12 * np.trace(curve) / len(curve) * np.eye(len(curve)))
        self.least = TOLERANCE * max(rows, 1)
        self.trial, self.w, self.passes, self.done = np.zeros(shape), None, 0, False
        self.pairs: list[tuple[np.ndarray, np.ndarray, float]] = []

    def look(self, loss: float, slope: np.ndarray) -> None:
        self.passes += 1
        loss, slope = loss + 0.5 * float((self.ridge * self.trial * self.trial).sum()), slope + self.ridge * self.trial
        if self.w is not None:
            gained = 1e-4 * self.size * float((self.slope * self.step).sum())
            if not loss <= self.loss + gained + 1e-13 * abs(self.loss):
                self.size /= 2
                if self.size < 1e-10:
                    self.done = True
                else:
                    self.trial = self.w + self.size * self.step
                return
            s, y = self.trial - self.w, slope - self.slope
            if (turn := float((s * y).sum())) > 1e-14 * np.linalg.norm(s) * np.linalg.norm(y):
                self.pairs = [*self.pairs[1 - MEMORY :], (s, y, turn)]
        self.w, self.loss, self.slope, self.size = self.trial, loss, slope, 1.0
        if np.abs(slope).max() <= self.least:
            self.done = True
            return
        self.step = self.direction()
        self.trial = self.w + self.step

    def direction(self) -> np.ndarray:
        q, shares = -self.slope.copy(), []
        for s, y, turn in reversed(self.pairs):
            shares.append(float((s * q).sum()) / turn)
            q -= shares[-1] * y
        scale = 1.0
        if self.pairs:
            _, y, turn = self.pairs[-1]
            scale = turn / float((y * (self.inverse @ y)).sum())
        q = scale * (self.inverse @ q)
        for (s, y, turn), share in zip(self.pairs, reversed(shares)):
            q += s * (share - float((y * q).sum()) / turn)
        return q


def numbered(items: DataFrame, keys: list[str]) -> tuple[list[tuple], DataFrame]:
    """The units (a row for each comes to the driver) and the items with their unit's number."""
    units = sorted((tuple(r) for r in items.select(*keys).distinct().collect() if None not in tuple(r)), key=str)
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    table = items.sparkSession.createDataFrame([(*u, i) for i, u in enumerate(units)], ", ".join([*(f"{k} {kinds[k]}" for k in keys), "unit int"]))
    return units, items.join(F.broadcast(table), keys)


def fit(items: DataFrame, keys: list[str], grid: Sequence[float] | Mapping[tuple, Sequence[float]], classes: Mapping[tuple, int] | None = None) -> dict[tuple, Probe]:
    """Probes by unit, of items (keys, v, label), for each C of ``grid`` (all units' or by unit).  ``classes``: labels counted from 0, if more than occur."""
    units, rows = numbered(items.where(F.col("v").isNotNull() & F.col("label").isNotNull()), keys)
    rows = written(rows.select("unit", F.col("label").cast("int").alias("label"), F.col("v").cast("array<double>").alias("v")), "probe-rows")
    labels = {r["unit"]: r["k"] for r in rows.groupBy("unit").agg((F.max("label") + 1).alias("k")).collect()}
    tasks = rows.rdd.getNumPartitions()
    sums = {u: x for (u, _), x in summed(rows, lambda u, x, y: {0: np.append(x.sum(0), len(x))}, tasks).items()}
    n = {u: x[-1] for u, x in sums.items()}
    mean = {u: x[:-1] / x[-1] for u, x in sums.items()}

    def centred(u: int, x: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
        z = x - mean[u]
        return {0: (z.T @ z).ravel()}

    gram = {u: g.reshape(len(mean[u]), -1) for (u, _), g in summed(rows, centred, tasks).items()}
    sd = {u: np.maximum(np.sqrt(np.diag(g) / (n[u] - 1)) if n[u] > 1 else np.ones(len(g)), 1e-6) for u, g in gram.items()}
    work: dict[tuple[int, int], Descent] = {}
    values = {u: list(grid[units[u]] if isinstance(grid, Mapping) else grid) for u in labels}
    for u, cs in values.items():
        scaled = gram[u] / np.outer(sd[u], sd[u])
        whole = np.block([[scaled, np.zeros((len(scaled), 1))], [np.zeros((1, len(scaled))), np.full((1, 1), n[u])]])
        k = max(labels[u], classes[units[u]] if classes else 0)
        for i, c in enumerate(cs):
            work[u, i] = Descent((len(whole), k), whole, int(n[u]), c)
    for _ in range(MOST_PASSES):
        live = {key: d.trial for key, d in work.items() if not d.done}
        if not live:
            break
        shared = rows.sparkSession.sparkContext.broadcast((live, mean, sd))

        def part(u: int, x: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
            live, mean, sd = shared.value
            z, out = (x - mean[u]) / sd[u], {}
            for (v, i), w in live.items():
                if v == u:
                    p = probabilities(z, w)
                    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
                    p[np.arange(len(y)), y] -= 1
                    out[i] = np.concatenate(([loss], np.concatenate((z.T @ p, p.sum(0)[None])).ravel()))
            return out

        used = sorted({u for u, _ in live})
        some = rows if len(used) == len(units) else rows.where(F.col("unit").isin(used))
        for key, total in summed(some, part, tasks).items():
            work[key].look(float(total[0]), total[1:].reshape(work[key].trial.shape))
        shared.destroy()
    if not all(d.done for d in work.values()):
        raise ValueError(f"no optimum after {MOST_PASSES} passes")
    out = {}
    for u in labels:
        found = {float(c): work[u, i] for i, c in enumerate(values[u])}
        out[units[u]] = Probe(mean[u], sd[u], {c: d.w for c, d in found.items()}, {c: d.passes for c, d in found.items()})
    return out


def score(items: DataFrame, keys: list[str], probes: Mapping[tuple, Probe], others: Sequence[str] = ()) -> DataFrame:
    """keys, c_value, row_id, ``others``, target, probs: each item (keys, row_id, v, label) by all probes of its unit."""
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    units = list(probes)
    spark = items.sparkSession
    table = spark.createDataFrame([(*u, i) for i, u in enumerate(units)], ", ".join([*(f"{k} {kinds[k]}" for k in keys), "unit int"]))
    kept = [*keys, "row_id", *others]
    given = items.join(F.broadcast(table), keys).select("unit", F.col("v").cast("array<double>").alias("v"), F.col("label").cast("int").alias("target"), *kept)
    shared = spark.sparkContext.broadcast([probes[u] for u in units])
    names = [*kept, "target", "c_value", "probs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = batch.column(0).to_numpy()
            for u in np.unique(unit):
                at = np.flatnonzero(unit == u)
                for first in range(0, len(at), ROWS):
                    rows = batch.take(pa.array(at[first : first + ROWS]))
                    probe = shared.value[u]
                    z = (matrix(rows.column(1)) - probe.mean) / probe.sd
                    for c, w in probe.weights.items():
                        p = probabilities(z, w)
                        probs = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                        yield pa.RecordBatch.from_arrays([*(rows.column(i + 3) for i in range(len(kept))), rows.column(2), pa.array(np.full(len(p), c)), probs], names=names)

    shape = ", ".join([*(f"{k} {kinds[k]}" for k in kept), "target int", "c_value double", "probs array<double>"])
    return given.mapInArrow(run, shape).select(*keys, "c_value", "row_id", *others, "target", "probs")
