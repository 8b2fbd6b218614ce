"""A probe's life: sweep on train and val, one refit, one test; the same probe outside; the same probe on rounded vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics, probe, softmax

TOLERANCE = 1e-6


def selected(items: DataFrame, keys: list[str], grid: tuple[float, ...] = probe.C_GRID) -> DataFrame:
    """keys, c_value: the C whose AUC on val, fitted on train, is best; ties go to the smaller C."""
    scores = metrics.auc_one_vs_rest(probe.sweep(items, keys, grid), [*keys, "c_value"]).withColumnRenamed("auc", "value")
    return probe.best_c(scores, keys).select(*keys, "c_value")


def refits(items: DataFrame, chosen: DataFrame, keys: list[str]) -> dict[tuple, softmax.Probe]:
    """Each unit's probe on train and val with its C (keys, c_value: a row for each unit)."""
    grid = {tuple(r)[:-1]: [r["c_value"]] for r in chosen.select(*keys, "c_value").collect()}
    return softmax.fit(items.where("part <> 'test'"), keys, grid, probe.classes_of(items, keys))


def refitted(items: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """keys, c_value, row_id, target, probs of the test part, by a refit on train and val with each unit's C."""
    return softmax.score(items.where("part = 'test'"), keys, refits(items, chosen, keys))


def run_units(items: DataFrame, keys: list[str], grid: tuple[float, ...] = probe.C_GRID) -> DataFrame:
    """The whole life of each unit: sweep, selection, one refit, one test.  items: keys, row_id, v, label, part."""
    return refitted(items, selected(items, keys, grid), keys)


def outside(items: DataFrame, external: DataFrame, stored: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Predictions of ``external`` (row_id, v, label) by each unit's refit with its stored C, applied unchanged.

    ``stored``: keys, c_value, auc.  A refit whose AUC on the unit's own test part
    isn't the stored one is an error when the rows are read.
    """
    probes = refits(items.join(stored.select(*keys), keys, "left_semi"), stored, keys)
    again = metrics.auc_one_vs_rest(softmax.score(items.where("part = 'test'"), keys, probes), keys)
    wrong = F.abs(F.col("again") - F.col("auc")) > tolerance
    checked = stored.join(again.select(*keys, F.col("auc").alias("again")), keys).select(*keys, F.when(F.col("again").isNull() | wrong, F.raise_error(F.lit("the refit isn't the stored probe"))).otherwise(F.lit(True)).alias("same"))
    other = external.select("row_id", "v", "label").join(stored.select(*keys))  # a row for each unit
    return softmax.score(other, keys, probes).join(checked, keys).where("same").drop("same")


def precisions(items: DataFrame, stored: DataFrame, keys: list[str], kinds: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, kind, row_id, target, probs: one refit of each unit scores its test part once for each way of rounding vectors."""
    probes = refits(items.join(stored.select(*keys), keys, "left_semi"), stored, keys)
    turned = F.explode(F.array(*(F.struct(F.lit(name).alias("kind"), f(F.col("v")).alias("v")) for name, f in kinds.items())))
    new = items.where("part = 'test'").withColumn("x", turned).withColumns({"kind": F.col("x.kind"), "v": F.col("x.v")}).drop("x")
    return softmax.score(new, keys, probes, ["kind"]).select(*keys, "kind", "row_id", "target", "probs")


def finished(records: DataFrame, signature: Column, grid: Column, selection: str, split: str, cap: int) -> DataFrame:
    """Run records (signature, grid, selection, split, max_iter, iterations) that count as done.

    They are of the present inputs, grid, selection and kind of split (older records lack the last two: auc,
    grouped), and no fit of theirs stopped at a lower cap of iterations than ``cap``.
    """
    same = (F.col("signature") == signature) & (F.col("grid") == grid)
    kind = (F.coalesce("selection", F.lit("auc")) == selection) & (F.coalesce("split", F.lit("grouped")) == split)
    limit = F.coalesce("max_iter", F.lit(1000))
    return records.where(same & kind & ((limit >= cap) | (F.array_max("iterations") < limit)))
