"""Frames behind the reports: summaries over seeds, wide tables, precision comparisons, samples and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import cosine, hash_text, shown, shown_sd

CEILING, AGREEMENT_MIN, COSINE_MIN = 0.999, 0.95, 0.99


def seed_summary(runs: DataFrame) -> DataFrame:
    """dataset, model, metric, mean, sd, n_seeds: sample deviation over seeds, 0 of a single one; undefined values don't count."""
    value = F.nanvl("value", F.lit(None).cast("double"))
    return runs.groupBy("dataset", "model", "metric").agg(F.avg(value).alias("mean"), F.when(F.count(value) == 1, 0.0).otherwise(F.stddev_samp(value)).alias("sd"), F.count(value).alias("n_seeds"))


def cells(summary: DataFrame, digits: int = 4) -> DataFrame:
    """Adds text: mean and deviation as shown in a table."""
    mean = shown(F.col("mean"), digits)
    text = F.when(F.col("n_seeds") > 1, F.concat(mean, F.lit("±"), shown_sd(F.col("sd")))).otherwise(mean)
    return summary.withColumn("text", text)


def wide(rows: DataFrame, row: list[str], column: str, value: str, values: list[str]) -> DataFrame:
    """One column for each of ``values``."""
    return rows.groupBy(*row).agg(*(F.max(F.when(F.col(column) == v, F.col(value))).alias(v) for v in values))


def main_table(summary: DataFrame, intervals: DataFrame, marked: DataFrame, datasets: list[str], digits: int = 4) -> DataFrame:
    """A row for each model, a column for each dataset: mean, deviation over seeds and interval, marked as the tests say; a missing cell is two dashes.

    summary: dataset, model, mean, sd, n_seeds; intervals: dataset, model, ci_low, ci_high; marked: dataset, model, mark.
    """
    keys = ["dataset", "model"]
    joined = cells(summary, digits).join(intervals.select(*keys, "ci_low", "ci_high"), keys, "left").join(marked.select(*keys, "mark"), keys, "left")
    between = F.when(F.col("ci_low").isNotNull(), F.concat(F.lit(" ["), shown(F.col("ci_low"), digits), F.lit(", "), shown(F.col("ci_high"), digits), F.lit("]"))).otherwise("")
    sign = F.when(F.col("mark") == "bold", "**").when(F.col("mark") == "under", "_").otherwise("")
    found = wide(joined.withColumn("cell", F.concat(sign, "text", between, sign)), ["model"], "dataset", "cell", datasets)
    return found.select("model", *(F.coalesce(F.col(f"`{x}`"), F.lit("--")).alias(x) for x in datasets))


def additional_models(summary: DataFrame, known: list[str], datasets: list[str]) -> DataFrame:
    """A row for each model beside the known ones, a column with the mean for each dataset."""
    return wide(summary.where(~F.col("model").isin(known)), ["model"], "dataset", "mean", datasets)


def agreement(variant: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """keys, agreement of predictions, mean and least cosine of vectors; both sides: keys, row_id, pred, v."""
    a, b = (t.select(*keys, "row_id", F.col("pred").alias(f"pred_{x}"), F.col("v").alias(f"v_{x}")) for t, x in ((variant, "a"), (reference, "b")))
    near = cosine(F.col("v_a"), F.col("v_b"))
    return a.join(b, [*keys, "row_id"]).groupBy(*keys).agg(F.avg((F.col("pred_a") == F.col("pred_b")).cast("double")).alias("agreement"), F.avg(near).alias("mean_cosine"), F.min(near).alias("min_cosine"))


def timing(repeats: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and sample deviation of milliseconds and of items a second over repeats (ms)."""
    rate = F.try_divide(F.lit(1000.0), F.col("ms"))
    return repeats.groupBy(*keys).agg(F.avg("ms").alias("ms"), F.stddev_samp("ms").alias("ms_sd"), F.avg(rate).alias("per_second"), F.stddev_samp(rate).alias("per_second_sd"), F.count("*").alias("n"))


def speed_up(means: DataFrame, reference: str) -> DataFrame:
    """model, kind, ratio of the reference kind's milliseconds to each kind's; means: model, kind, ms."""
    base = means.where(F.col("kind") == reference).select("model", F.col("ms").alias("base"))
    return means.where(F.col("kind") != reference).join(base, "model").select("model", "kind", F.try_divide(F.col("base"), F.col("ms")).alias("ratio"))


def qualitative(items: DataFrame, per_class: int, seed: int) -> DataFrame:
    """One item of each (class, group) and of those ``per_class`` groups of each class, both by hash."""
    one = W.partitionBy("target", "grp").orderBy(hash_text(seed, F.col("row_id")), "row_id")
    few = W.partitionBy("target").orderBy(hash_text(seed, F.col("grp")), "grp")
    first = items.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    return first.withColumn("_n", F.row_number().over(few)).where(F.col("_n") <= per_class).drop("_n")


def warnings(summary: DataFrame, runs: DataFrame) -> DataFrame:
    """dataset, kind, subject: ceilings of at least two models, and seeds that all agree."""
    high = summary.where(F.col("mean") >= CEILING).groupBy("dataset", "metric").agg(F.count("*").alias("n")).where("n >= 2").select("dataset", F.lit("ceiling").alias("kind"), F.col("metric").alias("subject"))
    flat = runs.groupBy("dataset", "model").agg(F.countDistinct("seed").alias("seeds"), F.max("metric").alias("_")).where("seeds > 1").select("dataset", "model")
    same = runs.join(flat, ["dataset", "model"]).groupBy("dataset", "model", "metric").agg((F.max("value") - F.min("value")).alias("spread")).groupBy("dataset", "model").agg(F.max("spread").alias("spread"))
    return high.unionByName(same.where("spread <= 1e-12").select("dataset", F.lit("identical seeds").alias("kind"), F.col("model").alias("subject")))


def mismatches(means: DataFrame, stats: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Means of the runs that the statistics lack or state otherwise."""
    keys = ["dataset", "model", "metric"]
    joined = means.join(stats.select(*keys, F.col("mean").alias("stated")), keys, "left")
    return joined.where(F.col("stated").isNull() | (F.abs(F.col("mean") - F.col("stated")) > tolerance))


def ordered(rows: DataFrame, known: list[str], column: str = "model") -> DataFrame:
    """Adds place: known names in their order, then others by name."""
    places = F.lit(None).cast("int")
    for i, name in enumerate(known):
        places = F.when(F.col(column) == name, F.lit(i)).otherwise(places)
    names = rows.select(column).distinct().withColumn("_known", F.coalesce(places, F.lit(len(known))))  # a row for each name
    names = names.withColumn("place", F.row_number().over(W.orderBy("_known", column)) - 1).drop("_known")
    return rows.join(names, column)


def majority_share(items: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Share of the most frequent class."""
    counts = items.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.try_divide(F.max("n").cast("double"), F.sum("n").cast("double")).alias("share"))


def complete(rows: DataFrame, unit: str, part: str) -> DataFrame:
    """Rows of the units that have every part."""
    parts = rows.select(F.countDistinct(part).alias("_parts"))
    units = rows.groupBy(unit).agg(F.countDistinct(part).alias("_parts")).join(parts, "_parts", "left_semi")
    return rows.join(units.select(unit), unit, "left_semi")


def single_seed(runs: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Runs of the smallest seed where all seeds agree, all runs elsewhere."""
    keys = ["dataset", "model", "metric"]
    spread = runs.groupBy(*keys).agg((F.max("value") - F.min("value")).alias("spread"))
    same = spread.groupBy("dataset").agg((F.max("spread") <= tolerance).alias("same"))
    first = runs.groupBy("dataset").agg(F.min("seed").alias("first"))
    return runs.join(same.join(first, "dataset"), "dataset").where(~F.col("same") | (F.col("seed") == F.col("first"))).drop("same", "first")


def side_by_side(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str]) -> DataFrame:
    """Values of two result sets next to each other; either may lack a row."""
    a, b = (t.select(*keys, F.col("value").alias(n)) for t, n in zip((left, right), names))
    return a.join(b, keys, "full").withColumn("difference", F.col(names[0]) - F.col(names[1]))


def heatmap(values: DataFrame) -> DataFrame:
    """dataset, model, value with its shade between the data set's least (0) and largest value (1; null if all are equal), and whether it is the best."""
    by = W.partitionBy("dataset")
    low, high = F.min("value").over(by), F.max("value").over(by)
    return values.select("dataset", "model", "value", F.try_divide(F.col("value") - low, high - low).alias("shade"), (F.col("value") == high).alias("best"))


def bars(intervals: DataFrame) -> DataFrame:
    """dataset, model, place, mean and the lengths of the bars below and above it, best first."""
    place = F.row_number().over(W.partitionBy("dataset").orderBy(F.round("mean", 9).desc(), "model"))
    return intervals.select("dataset", "model", place.alias("place"), "mean", (F.col("mean") - F.col("ci_low")).alias("below"), (F.col("ci_high") - F.col("mean")).alias("above"))


def environment(spark) -> DataFrame:
    """One row on the software that made a result; what can't be read is null."""
    import platform

    import numpy
    import pandas
    import pyarrow

    row = {"spark": spark.version, "python": platform.python_version(), "numpy": numpy.__version__, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__, "partitions": spark.conf.get("spark.sql.shuffle.partitions", None)}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))


def ledger(steps: dict) -> tuple[dict, list[tuple[str, str, str]]]:
    """Results of report steps by name, and (step, kind, message) of those that failed; a failure doesn't stop the others."""
    done, notes = {}, []
    for name, step in steps.items():
        try:
            done[name] = step()
        except Exception as e:  # noqa: BLE001  isolation is the point
            notes.append((name, "failed", str(e)[:200]))
    return done, notes
