"""Pooling, standardising, comparing and searching embedding vectors."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import cosine, softmax
from . import neighbours


def pool_mean(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Elementwise mean of each group's vectors, in double precision; needs no group in one place."""
    some = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    return some.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))).alias(vector))


def pool_children(parents: DataFrame, children: DataFrame, key: str, vector: str) -> DataFrame:
    """Pooled vector of every parent; a parent without children is an error."""
    joined = parents.join(pool_mean(children, [key], vector), key, "left")
    return joined.withColumn(vector, F.when(F.col(vector).isNull(), F.raise_error(F.concat(F.lit("no children: "), F.col(key).cast("string")))).otherwise(F.col(vector)))


def bags(rows: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """Rows of each bag in order, with its label; labels that differ within a bag are an error."""
    found = rows.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("rows"), F.min(label).alias("low"), F.max(label).alias("high"))
    checked = F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low")).otherwise(F.raise_error(F.lit("labels differ within a bag")).cast("int"))
    return found.select(key, "rows", checked.alias(label))


def moments(rows: DataFrame, vector: str) -> DataFrame:
    """Mean and sample deviation of each dimension, deviations at least 1e-6."""
    each = rows.select(F.posexplode(vector).alias("pos", "x"))
    return each.groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.greatest(F.stddev_samp(F.col("x").cast("double")), F.lit(1e-6)).alias("sd"))


def standardise(rows: DataFrame, fitted: DataFrame, vector: str) -> DataFrame:
    """Vectors by the moments of the fitting rows alone; the moments are as many numbers as a vector has."""
    m = {r["pos"]: (r["mean"], r["sd"]) for r in moments(fitted, vector).collect()}
    mean, sd = (F.array(*(F.lit(float(m[i][k])) for i in range(len(m)))) for k in (0, 1))
    z = F.zip_with(F.zip_with(F.col(vector), mean, lambda x, a: x.cast("double") - a), sd, lambda x, s: x / s)
    return rows.withColumn(vector, z)


def variants(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """A row for each item and embedding key: the whole vector, its first half, its second half."""
    half = F.floor(F.size(vector) / 2).cast("int")
    keys = F.array(
        F.struct(F.lit("official").alias("model"), F.col(vector).alias("v")),
        F.struct(F.lit("cls").alias("model"), F.slice(vector, F.lit(1), half).alias("v")),
        F.struct(F.lit("patch_mean").alias("model"), F.slice(vector, half + 1, half).alias("v")),
    )
    others = [c for c in rows.columns if c != vector]
    return rows.select(*others, F.explode(keys).alias("x")).select(*others, "x.model", "x.v")


def centroid_probabilities(rows: DataFrame, keys: list[str], vector: str = "v", label: str = "label", sharpness: float = 10.0, digits: int = 6, fit: Column | None = None) -> DataFrame:
    """Adds probs: the softmax of the cosines with the class centroids of the same keys.

    Centroids come from all rows, or those that ``fit`` picks; a row of the side that is joined holds the
    centroids of one key, as many as there are classes.
    """
    centres = pool_mean(rows if fit is None else rows.where(fit), [*keys, label], vector)
    sets = centres.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col(vector).alias("c")))).alias("centres"))
    near = F.transform("centres", lambda c: cosine(F.col(vector), c["c"]) * sharpness)
    return rows.join(F.broadcast(sets), keys).withColumn("probs", F.transform(softmax(near), lambda p: F.round(p, digits))).drop("centres")


def nearest(rows: DataFrame, k: int, block_rows: int | None = None, owner: str | None = None, permutations: list[list[int]] | None = None) -> DataFrame:
    """id, rank, other, similarity: the k rows of largest inner product with each row (id, v), none of its own owner.

    Exactly as all rows against all rows; see ``neighbours`` for the blocks that are left out.
    ``permutations``: the largest product with any of these orders of the other vector's cells counts.
    """
    return neighbours.search(rows, k, block_rows, owner, permutations).rows


def token_features(tokens: Column, prefix: int = 1) -> Column:
    """The first of some token vectors, and the mean of those after the ``prefix`` first ones, in one vector."""
    patches = F.slice(tokens, F.lit(prefix + 1), F.greatest(F.size(tokens) - prefix, F.lit(0)))
    zero = F.transform(F.get(tokens, F.lit(0)), lambda x: x * 0.0)
    total = F.aggregate(patches, zero, lambda a, t: F.zip_with(a, t, lambda x, y: x + y))
    return F.concat(F.get(tokens, F.lit(0)), F.transform(total, lambda x: F.try_divide(x, F.size(patches))))


def ratio_test(top_two: DataFrame, ratio: float = 0.8) -> DataFrame:
    """id, other, d1, d2, kept: nearest and second distance of unit vectors, and whether the first is clearly nearer."""
    distance = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity")))
    pair = top_two.groupBy("id").agg(F.min_by("other", "rank").alias("other"), F.min(distance).alias("d1"), F.max(distance).alias("d2"), F.count("*").alias("n")).where("n = 2")
    return pair.select("id", "other", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"), (F.col("d1") < F.col("d2") * ratio).alias("kept"))


def attention_pool(weights_v: np.ndarray, weights_u: np.ndarray, w: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gated attention over a bag: its weights (sum 1) and the pooled vector."""
    score = (np.tanh(bag @ weights_v) / (1 + np.exp(-(bag @ weights_u)))) @ w
    e = np.exp(score - score.max())
    share = e / e.sum()
    return share, share @ bag

