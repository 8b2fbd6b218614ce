"""Weighted classification metrics of prediction tables.

Predictions have key columns, target, probs and an optional weight w.  Undefined
values are null.  Everything is grouped before it is joined or ordered; running
sums over scores go by score buckets, so no task orders all scores of a model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import argmax

BUCKETS = 4096


def with_prediction(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("pred", argmax(F.col("probs")))


def confusion(predictions: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """keys, target, pred, w."""
    w = F.sum(weight) if weight else F.count("*").cast("double")
    rows = predictions if "pred" in predictions.columns else with_prediction(predictions)
    if weight:
        rows = rows.where(F.col(weight) > 0)
    return rows.groupBy(*keys, "target", "pred").agg(w.alias("w"))


def from_confusion(table: DataFrame, keys: list[str]) -> DataFrame:
    """keys, acc, bal_acc, f1_weighted, f1_macro, qwk.  QWK counts positions among the labels that occur."""
    w, zero = F.col("w"), F.lit(0.0)
    sides = table.select(*keys, F.col("target").alias("label"), w.alias("row"), zero.alias("col"), F.when(F.col("target") == F.col("pred"), w).otherwise(zero).alias("hit"))
    sides = sides.unionByName(table.select(*keys, F.col("pred").alias("label"), zero.alias("row"), w.alias("col"), zero.alias("hit")))
    labels = sides.groupBy(*keys, "label").agg(F.sum("row").alias("row"), F.sum("col").alias("col"), F.sum("hit").alias("hit"))
    labels = labels.withColumn("at", (F.row_number().over(W.partitionBy(*keys).orderBy("label")) - 1).cast("double"))
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("row") + F.col("col")), zero)
    p, row, col = F.col("at"), F.col("row"), F.col("col")
    sums = labels.groupBy(*keys).agg(
        F.try_divide(F.sum("hit"), F.sum("row")).alias("acc"),
        F.avg(F.try_divide(F.col("hit"), F.when(row > 0, row))).alias("bal_acc"),
        F.try_divide(F.sum(f1 * row), F.sum("row")).alias("f1_weighted"),
        F.avg(f1).alias("f1_macro"),
        F.sum("row").alias("n"),
        (F.sum(row) * F.sum(row * p * p) - 2 * F.sum(row * p) * F.sum(col * p) + F.sum(row) * F.sum(col * p * p)).alias("expected"),
    )
    place = labels.select(*keys, "label", "at")
    rows = table.join(place.withColumnRenamed("label", "target").withColumnRenamed("at", "i"), [*keys, "target"]).join(place.withColumnRenamed("label", "pred").withColumnRenamed("at", "j"), [*keys, "pred"])
    seen = rows.groupBy(*keys).agg(F.sum(w * (F.col("i") - F.col("j")) * (F.col("i") - F.col("j"))).alias("seen"))
    qwk = 1 - F.try_divide(F.col("seen") * F.col("n"), F.col("expected"))
    return sums.join(seen, keys).select(*keys, "acc", "bal_acc", "f1_weighted", "f1_macro", qwk.alias("qwk"))


def auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, auc, positives of rows (keys, score, positive, w): rank sums with ties at half, null if a class is missing."""
    at = scored.groupBy(*keys, "score").agg(F.sum(F.when(F.col("positive"), F.col("w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("positive"), 0.0).otherwise(F.col("w"))).alias("neg"))
    at = at.withColumn("bucket", F.floor(F.col("score") * BUCKETS))
    buckets = at.groupBy(*keys, "bucket").agg(F.sum("neg").alias("total"))
    below = F.sum("total").over(W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    buckets = buckets.select(*keys, "bucket", F.coalesce(below, F.lit(0.0)).alias("under"))
    within = F.sum("neg").over(W.partitionBy(*keys, "bucket").orderBy("score").rowsBetween(W.unboundedPreceding, -1))
    ranked = at.withColumn("less", F.coalesce(within, F.lit(0.0))).join(buckets, [*keys, "bucket"])
    wins = F.sum(F.col("pos") * (F.col("under") + F.col("less") + F.col("neg") / 2))
    return ranked.groupBy(*keys).agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("positives"))


def auc_binary(predictions: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return auc(predictions.select(*keys, F.get("probs", F.lit(1)).alias("score"), (F.col("target") == 1).alias("positive"), w.alias("w")), keys).select(*keys, "auc")


def auc_one_vs_rest(predictions: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Mean over classes, weighted by prevalence; null where any class has none or all of the rows."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = predictions.select(*keys, "target", w.alias("w"), F.posexplode("probs").alias("class", "score"))
    each = auc(rows.select(*keys, "class", "score", (F.col("target") == F.col("class")).alias("positive"), "w"), [*keys, "class"])
    known = F.count("auc") == F.count("*")
    return each.groupBy(*keys).agg(F.when(known, F.try_divide(F.sum(F.col("auc") * F.col("positives")), F.sum("positives"))).alias("auc"))


def log_loss(predictions: DataFrame, keys: list[str], floor: float = 1e-12) -> DataFrame:
    own = F.get("probs", F.col("target"))
    return predictions.groupBy(*keys).agg(F.avg(-F.log(F.greatest(own, F.lit(floor)))).alias("log_loss"))


def primary_metric(task: str, ordinal: frozenset[str] = frozenset()) -> str:
    """What models of a task are ranked by: QWK where its classes are ordered, else AUC."""
    return "qwk" if task in ordinal else "auc"


def aligned(predictions: DataFrame) -> DataFrame:
    """dataset, seed, items, models, ok: whether all models have the same items with the same targets."""
    items = predictions.groupBy("dataset", "seed", "row_id").agg(F.countDistinct("model").alias("m"), F.count("*").alias("n"), F.countDistinct("target").alias("targets"))
    models = predictions.groupBy("dataset", "seed").agg(F.countDistinct("model").alias("models"))
    joined = items.join(models, ["dataset", "seed"])
    fine = (F.col("m") == F.col("models")) & (F.col("n") == F.col("m")) & (F.col("targets") == 1)
    return joined.groupBy("dataset", "seed").agg(F.count("*").alias("items"), F.max("models").alias("models"), F.min(fine).alias("ok"))
