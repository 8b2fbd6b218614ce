"""Multinomial draws of groups by splitting, for the cluster bootstrap.

Groups are leaves of a binary tree: a group's way from the root is the bits of the
hash of its name.  A replicate draws as many groups as there are, with replacement.
Instead of drawing one by one, each node splits the draws that reach it between its
two sides: the left side's share is binomial with the share of groups there, and comes
from a hash of dataset, seed, replicate, attempt and node by the inverse distribution
function.  The leaves' numbers are then exactly multinomial, their sum is the number of
groups, and no row is made for a draw.  A group's draws in all replicates are one row.

The tree is walked ``TIER`` levels at a time; each node of a tier is a task of its own
with the counts of the nodes below it, until a node has ``LEAVES`` groups or fewer.
The tree doesn't depend on that, so neither do the draws.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written

TIER, LEAVES = 8, 512
MOST_ATTEMPTS = 100
#: Hexadecimal digits of a hash that make a uniform number.
DIGITS = 13


@functools.lru_cache(1 << 16)
def distribution(n: int, left: int, whole: int) -> tuple[int, np.ndarray]:
    """First value, and the distribution function from there on, of a binomial variable, without tails below 1e-30."""
    p, middle = left / whole, n * left / whole
    reach = 12 * math.sqrt(max(middle * (1 - p), 0)) + 40
    low, high = max(0, math.floor(middle - reach)), min(n, math.ceil(middle + reach))
    first = math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) + low * math.log(p) + (n - low) * math.log1p(-p)
    k = np.arange(low, high)
    steps = np.log((n - k) / (k + 1)) + math.log(p) - math.log1p(-p)
    return low, np.cumsum(np.exp(first + np.concatenate(([0.0], np.cumsum(steps)))))


def split(draws: np.ndarray, left: int, whole: int, uniform: np.ndarray) -> np.ndarray:
    """Of each replicate's draws, those of the left side."""
    out = np.zeros_like(draws)
    for n in np.unique(draws[draws > 0]).tolist():
        low, known = distribution(n, left, whole)
        at = np.flatnonzero(draws == n)
        out[at] = np.minimum(low + np.searchsorted(known, uniform[at], side="left"), n)
    return out


def uniform(dataset: str, seed: int, attempts: np.ndarray, node: str) -> np.ndarray:
    """A number for each replicate (from 1)."""
    digest = hashlib.md5
    return np.array([int(digest(f"{dataset}:{seed}:{b}:{a}:{node}".encode()).hexdigest()[:DIGITS], 16) for b, a in enumerate(attempts.tolist(), 1)]) / float(16**DIGITS)


def descend(dataset: str, seed: int, attempts: np.ndarray, node: str, draws: np.ndarray, bits: list[str], counts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(position, draws) for each of the sorted ``bits`` below a node; ``counts`` are the groups of each."""
    total = np.concatenate(([0], np.cumsum(counts)))
    waiting = [(node, draws, 0, len(bits))]
    while waiting:
        node, draws, low, high = waiting.pop()
        if high - low == 1:
            yield low, draws
            continue
        depth = len(node)
        middle = low + sum(b[depth] == "0" for b in bits[low:high])
        if low < middle < high:
            left = split(draws, int(total[middle] - total[low]), int(total[high] - total[low]), uniform(dataset, seed, attempts, node))
            waiting += [(node + "0", left, low, middle), (node + "1", draws - left, middle, high)]
        else:
            waiting.append((node + ("0" if middle == high else "1"), draws, low, high))


UNIT = "dataset string, seed long"


def drawn(groups: DataFrame, attempts: dict[tuple[str, int], np.ndarray]) -> DataFrame:
    """dataset, seed, grp, weights (32-bit numbers, one for each replicate) of distinct groups (dataset, seed, grp).

    ``attempts``: the number of the attempt for each replicate of a unit (a row for each unit).
    """
    spark = groups.sparkSession
    rows = groups.select("dataset", "seed", "grp", F.md5(F.col("grp").cast("binary")).alias("digest"))
    rows = written(rows, "groups")
    sizes = {(r["dataset"], r["seed"]): r["n"] for r in rows.groupBy("dataset", "seed").agg(F.count("*").alias("n")).collect()}
    start = [(d, s, "", np.full(len(attempts[d, s]), n, "<u4").tobytes()) for (d, s), n in sizes.items()]
    nodes = spark.createDataFrame(start, f"{UNIT}, node string, draws binary")
    tiers = max(0, math.ceil(math.log2(max([1, *sizes.values()]) / LEAVES) / TIER)) if sizes else 0
    # a node's name is its first hexadecimal digits: TIER bits are two of them
    node_schema = pa.schema([("dataset", pa.string()), ("seed", pa.int64()), ("node", pa.string()), ("draws", pa.binary())])
    leaf_schema = pa.schema([("dataset", pa.string()), ("seed", pa.int64()), ("grp", pa.string()), ("weights", pa.binary())])

    def below(whole: str, left: pa.Table, right: pa.Table, schema: pa.Schema) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        dataset, seed, node = (left[c][0].as_py() for c in ("dataset", "seed", "node"))
        at = sorted(range(right.num_rows), key=right["digest"].to_pylist().__getitem__)
        digests = [right["digest"][i].as_py() for i in at]
        bits = [format(int(x, 16), f"0{4 * len(x)}b") for x in digests]
        names = [right[whole][i].as_py() for i in at]
        counts = right["n"].to_numpy()[at]
        prefix = format(int(node, 16), f"0{4 * len(node)}b") if node else ""
        draws = np.frombuffer(left["draws"][0].as_py(), "<u4").astype(np.int64)
        found = [(names[i], w.astype("<u4").tobytes()) for i, w in descend(dataset, seed, attempts[dataset, seed], prefix, draws, bits, counts)]
        return pa.Table.from_arrays([pa.array([dataset] * len(found)), pa.array([seed] * len(found), pa.int64()), pa.array([f for f, _ in found]), pa.array([w for _, w in found], pa.binary())], schema=schema)

    for tier in range(tiers):
        cut = TIER // 4 * (tier + 1)
        counts = rows.groupBy("dataset", "seed", F.substring("digest", 1, cut).alias("digest")).agg(F.count("*").alias("n"))
        counts = counts.withColumn("node", F.substring("digest", 1, cut - TIER // 4))
        nodes = nodes.groupBy("dataset", "seed", "node").cogroup(counts.groupBy("dataset", "seed", "node")).applyInArrow(lambda a, b: below("digest", a, b, node_schema), f"{UNIT}, node string, draws binary")
    last = rows.withColumn("node", F.substring("digest", 1, TIER // 4 * tiers)).withColumn("n", F.lit(1).cast("long"))
    return nodes.groupBy("dataset", "seed", "node").cogroup(last.groupBy("dataset", "seed", "node")).applyInArrow(lambda a, b: below("grp", a, b, leaf_schema), f"{UNIT}, grp string, weights binary")


def lacking(weights: DataFrame, classes: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """By unit, which replicates lack a class; ``classes``: dataset, seed, grp, target, distinct."""
    schema = pa.schema([("dataset", pa.string()), ("seed", pa.int64()), ("target", pa.int64()), ("seen", pa.binary())])

    def seen(rows: pa.Table) -> pa.Table:
        total = None
        for x in rows["weights"]:
            now = np.frombuffer(x.as_buffer(), "<u4") > 0
            total = now if total is None else total | now
        return pa.Table.from_arrays([*(rows[c].slice(0, 1) for c in ("dataset", "seed", "target")), pa.array([total.tobytes()], pa.binary())], schema=schema)

    both = weights.join(classes.select("dataset", "seed", "grp", F.col("target").cast("long").alias("target")), ["dataset", "seed", "grp"])
    parts = both.withColumn("block", F.pmod(F.xxhash64("grp"), F.lit(256))).groupBy("dataset", "seed", "target", "block").applyInArrow(seen, f"{UNIT}, target long, seen binary")
    out: dict[tuple[str, int], np.ndarray] = {}
    # 256 rows at most for each class of a unit, a byte for each replicate
    by_class: dict[tuple, np.ndarray] = {}
    for r in parts.collect():
        key, x = (r["dataset"], r["seed"], r["target"]), np.frombuffer(r["seen"], bool)
        by_class[key] = by_class[key] | x if key in by_class else x
    for (d, s, _), x in by_class.items():
        out[d, s] = out[d, s] | ~x if (d, s) in out else ~x
    return out


def resampled(predictions: DataFrame, replicates: int) -> DataFrame:
    """dataset, seed, grp, weights of all groups of ``predictions`` (dataset, seed, grp, target); a replicate without some class is drawn anew."""
    rows = predictions.select(F.col("dataset").cast("string").alias("dataset"), F.col("seed").cast("long").alias("seed"), F.col("grp").cast("string").alias("grp"), "target")
    classes = written(rows.distinct(), "group-classes")
    groups = classes.select("dataset", "seed", "grp").distinct()
    units = [tuple(r) for r in groups.select("dataset", "seed").distinct().collect()]
    attempts = {u: np.zeros(replicates, np.int64) for u in units}
    for _ in range(MOST_ATTEMPTS):
        weights = written(drawn(groups, attempts), "draws")
        again = lacking(weights, classes)
        if not any(x.any() for x in again.values()):
            return weights
        attempts = {u: a + again[u] for u, a in attempts.items()}
    raise ValueError(f"no resample with all classes in {MOST_ATTEMPTS} attempts")
