"""Gated attention over bags of vectors, trained by mini-batches over all partitions.

A row is a bag: its vectors, label and part (train, val, test).  A mini-batch is the
bags whose hash of seed, epoch and bag falls on its number.  Each epoch deals the bags
out once, so that a mini-batch is one partition, or several if it is large; a step runs
on these alone, and so costs the same however many bags there are.  Tasks add up the
gradients of their bags, and the driver, which holds weights and moments alone, takes one
step of AdamW.  All units take their steps in the same passes.  After each epoch the val part
is scored; a unit stops when ``patience`` epochs brought no better value, and its
weights of the best epoch are kept.

A bag of vectors, whatever their number, has one row of attention that sums to 1, so
nothing is padded.  Empty bags, and null vectors or labels, are errors.  Dropout is
drawn from seed, epoch and bag, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..sources.storage import written
from . import metrics

#: Bytes of a mini-batch that a task reads, at about.
BATCH_BYTES = 1 << 26


@dataclass(frozen=True)
class Settings:
    hidden: int = 256
    attention: int = 128
    dropout: float = 0.25
    epochs: int = 50
    patience: int = 10
    batch: int = 32
    rate: float = 2e-4
    decay: float = 1e-4
    seed: int = 42
    metric: str = "qwk"


Weights = dict[str, np.ndarray]


def start(width: int, classes: int, s: Settings) -> Weights:
    """Uniform weights within one over the root of the number of inputs."""
    rng = np.random.default_rng(s.seed)
    layer = lambda i, o: (rng.uniform(-1, 1, (i, o)) / np.sqrt(i), rng.uniform(-1, 1, o) / np.sqrt(i))
    out: Weights = {}
    for name, i, o in (("embed", width, s.hidden), ("tanh", s.hidden, s.attention), ("gate", s.hidden, s.attention), ("score", s.attention, 1), ("head", s.hidden, classes)):
        out[name], out[f"{name}0"] = layer(i, o)
    return out


def forward(w: Weights, x: np.ndarray, mask: np.ndarray | float = 1.0) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Class probabilities of a bag, and what the way back needs."""
    lifted = x @ w["embed"] + w["embed0"]
    h = np.maximum(lifted, 0) * mask
    t, g = np.tanh(h @ w["tanh"] + w["tanh0"]), 1 / (1 + np.exp(-(h @ w["gate"] + w["gate0"])))
    s = ((t * g) @ w["score"] + w["score0"])[:, 0]
    e = np.exp(s - s.max())
    share = e / e.sum()
    pooled = share @ h
    out = pooled @ w["head"] + w["head0"]
    p = np.exp(out - out.max())
    return p / p.sum(), {"lifted": lifted, "h": h, "t": t, "g": g, "share": share, "pooled": pooled}


def backward(w: Weights, x: np.ndarray, label: int, mask: np.ndarray | float = 1.0) -> tuple[float, Weights]:
    """Loss of a bag and its gradients."""
    p, k = forward(w, x, mask)
    d = {}
    dout = p - np.eye(len(p))[label]
    d["head"], d["head0"] = np.outer(k["pooled"], dout), dout
    dpooled = w["head"] @ dout
    dshare = k["h"] @ dpooled
    ds = k["share"] * (dshare - k["share"] @ dshare)
    d["score"], d["score0"] = ((k["t"] * k["g"]).T @ ds)[:, None], ds.sum()[None]
    both = np.outer(ds, w["score"][:, 0])
    dt, dg = both * k["g"] * (1 - k["t"] ** 2), both * k["t"] * k["g"] * (1 - k["g"])
    d["tanh"], d["tanh0"], d["gate"], d["gate0"] = k["h"].T @ dt, dt.sum(0), k["h"].T @ dg, dg.sum(0)
    dh = np.outer(k["share"], dpooled) + dt @ w["tanh"].T + dg @ w["gate"].T
    dlifted = dh * mask * (k["lifted"] > 0)
    d["embed"], d["embed0"] = x.T @ dlifted, dlifted.sum(0)
    return -float(np.log(max(p[label], 1e-300))), d


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def shaped(values: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


@dataclass
class Training:
    """A unit's weights with the moments of AdamW, its history (epoch, train_loss, value) and its best weights."""

    w: Weights
    first: np.ndarray = field(init=False)
    second: np.ndarray = field(init=False)
    steps: int = 0
    history: list[tuple[int, float, float]] = field(default_factory=list)
    best: tuple[float, int, Weights | None] = (-np.inf, 0, None)
    done: bool = False

    def __post_init__(self) -> None:
        self.first = np.zeros(flat(self.w).size)
        self.second = self.first.copy()

    def step(self, gradient: np.ndarray, s: Settings) -> None:
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        move = self.first / (1 - 0.9**self.steps) / (np.sqrt(self.second / (1 - 0.999**self.steps)) + 1e-8)
        now = flat(self.w)
        self.w = shaped(now - s.rate * s.decay * now - s.rate * move, self.w)

    def ended(self, epoch: int, loss: float, value: float, s: Settings) -> None:
        """Keeps the first best epoch; an undefined value is no better than any."""
        self.history.append((epoch, loss, value))
        if value > self.best[0] or self.best[2] is None:
            self.best = (value if value == value else -np.inf, epoch, self.w)
        elif epoch - self.best[1] >= s.patience:
            self.done = True


def bag_matrix(items: pa.Scalar) -> np.ndarray:
    """A bag's vectors (list of lists) as a matrix."""
    vectors = items.values
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def drawn_mask(s: Settings, epoch: int, bag: int, rows: int) -> np.ndarray | float:
    if not s.dropout:
        return 1.0
    rng = np.random.default_rng([s.seed, epoch, bag & (1 << 63) - 1])
    return (rng.random((rows, s.hidden)) >= s.dropout) / (1 - s.dropout)


def packed(rows: DataFrame) -> DataFrame:
    """unit, bag, label, size, data: the vectors of a bag as its size and the bytes of its doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag_matrix(x) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in found], pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())], names=["unit", "bag", "label", "size", "data"])

    return rows.select("unit", "bag", "label", "items").mapInArrow(run, "unit int, bag long, label int, size int, data binary")


def dealt(bags: DataFrame, batches: int, parts: int, epoch: int, s: Settings) -> RDD:
    """Packed bags of an epoch: mini-batch b is partitions b * parts and the ``parts`` - 1 after it."""
    place = F.pmod(F.xxhash64(F.lit(s.seed), F.lit(epoch), F.col("bag")), F.lit(batches)) * parts + F.pmod(F.xxhash64("bag"), F.lit(parts))
    return bags.repartitionById(batches * parts, place.cast("int")).rdd


def gradients(bags: RDD, places: Iterable[int], weights: Mapping[int, Weights], epoch: int, s: Settings) -> dict[int, np.ndarray]:
    """Of each unit: bags, summed loss and summed gradient of the packed bags in some partitions; the others are not read."""
    shared = bags.context.broadcast(dict(weights))

    def run(rows: Iterator[Row]) -> Iterator[tuple[int, np.ndarray]]:
        held: dict[int, np.ndarray] = {}
        for u, bag, label, size, data in sorted(rows, key=lambda r: r[:2]):
            if u in shared.value:
                x = np.frombuffer(data).reshape(size, -1)
                loss, d = backward(shared.value[u], x, label, drawn_mask(s, epoch, bag, size))
                one = np.concatenate(([1.0, loss], flat(d)))
                held[u] = held[u] + one if u in held else one
        yield from held.items()

    out: dict[int, np.ndarray] = {}
    for u, x in bags.context.runJob(bags, run, list(places)):  # as wide as a unit's weights
        out[u] = out[u] + x if u in out else x
    shared.destroy()
    return out


def probabilities(rows: DataFrame, weights: Mapping[int, Weights]) -> DataFrame:
    """unit, bag, target, probs of some bags."""
    shared = rows.sparkSession.sparkContext.broadcast(dict(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array([u in shared.value for u in batch.column(0).to_pylist()], pa.bool_()))
            probs = [forward(shared.value[u], bag_matrix(some.column(3)[i]))[0].tolist() for i, u in enumerate(some.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(probs, pa.list_(pa.float64()))], names=["unit", "bag", "target", "probs"])

    return rows.select("unit", "bag", "label", "items").mapInArrow(run, "unit int, bag long, target int, probs array<double>")


def values(scored: DataFrame, s: Settings) -> dict[int, float]:
    found = metrics.auc_one_vs_rest(scored, ["unit"]) if s.metric == "auc" else metrics.from_confusion(metrics.confusion(scored, ["unit"]), ["unit"])
    return {r["unit"]: float("nan") if r[s.metric] is None else r[s.metric] for r in found.select("unit", s.metric).collect()}


def train(bags: DataFrame, keys: list[str], s: Settings = Settings()) -> tuple[dict[tuple, Training], DataFrame]:
    """Trainings by unit, and test predictions (keys, bag, target, probs) by the weights of the best epoch.

    bags: keys, bag, label, part (train, val, test), items (array of vectors).
    """
    kinds = {f.name: f.dataType.simpleString() for f in bags.schema}
    spark = bags.sparkSession
    wrong = F.col("label").isNull() | F.coalesce(F.size("items") < 1, F.lit(True)) | F.exists("items", lambda v: v.isNull())
    checked = bags.withColumn("items", F.when(wrong, F.raise_error(F.concat(F.lit("empty or broken bag "), F.col("bag").cast("string")))).otherwise(F.col("items")))
    shape = bags.groupBy(*keys).agg((F.max("label") + 1).alias("k"), F.max(F.size(F.get("items", F.lit(0)))).alias("d"), F.count(F.when(F.col("part") == "train", 1)).alias("n"), F.sum(F.when(F.col("part") == "train", F.size("items"))).alias("vectors")).collect()  # a row for each unit
    units = sorted((tuple(r)[: len(keys)] for r in shape), key=str)
    number = {u: i for i, u in enumerate(units)}
    table = spark.createDataFrame([(*u, i) for u, i in number.items()], ", ".join([*(f"{k} {kinds[k]}" for k in keys), "unit int"]))
    rows = checked.join(F.broadcast(table), keys).select("unit", F.col("bag").cast("long").alias("bag"), F.col("label").cast("int").alias("label"), "part", F.col("items").cast("array<array<double>>").alias("items"))
    rows = written(rows, "bags")
    runs = {number[tuple(r)[: len(keys)]]: Training(start(r["d"], r["k"], s)) for r in shape}
    batches = max(1, -(-max(r["n"] for r in shape) // s.batch))
    size = sum((r["vectors"] or 0) * (r["d"] or 0) * 8 for r in shape)
    parts = max(1, -(-size // (batches * BATCH_BYTES)))
    bags = written(packed(rows.where("part = 'train'")), "packed-bags")
    for epoch in range(1, s.epochs + 1):
        live = {u: t for u, t in runs.items() if not t.done}
        if not live:
            break
        drawn = dealt(bags.where(F.col("unit").isin(*live)), batches, parts, epoch, s)
        loss, seen = dict.fromkeys(live, 0.0), dict.fromkeys(live, 0.0)
        for b in range(batches):
            for u, total in gradients(drawn, range(b * parts, (b + 1) * parts), {u: t.w for u, t in live.items()}, epoch, s).items():
                seen[u] += total[0]
                loss[u] += total[1]
                live[u].step(total[2:] / total[0], s)
        value = values(probabilities(rows.where("part = 'val'"), {u: t.w for u, t in live.items()}), s)
        for u, t in live.items():
            t.ended(epoch, loss[u] / max(seen[u], 1.0), value.get(u, float("nan")), s)
    found = probabilities(rows.where("part = 'test'"), {u: t.best[2] or t.w for u, t in runs.items()})
    return {u: runs[i] for u, i in number.items()}, found.join(F.broadcast(table), "unit").select(*keys, "bag", "target", "probs")
