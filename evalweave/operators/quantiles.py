"""Exact quantiles of groups of any size, by histograms that are refined in passes.

Each wanted rank of a group has an interval that holds it, at first from the group's
smallest to its largest value.  A pass counts the rows of ``BINS`` equal parts of each
open interval and goes on with the part that holds the rank, from the smallest to the
largest value in it.  An interval of one value, or of ``HELD`` rows or fewer, is
closed; the few rows of the latter are sorted.  So no task holds a group's values.

Between ranks, values are interpolated as ``percentile`` does.  Nulls and NaN are left
out; a group without values has none; a null key is a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import written

BINS, HELD = 1024, 4096


def ranked_values(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """k, rank, value of the wanted ranks (k, rank, lo, hi, before, n; from 0) among rows (k, v)."""
    closed, opened = targets.where(f"n <= {HELD} or lo = hi"), targets.where(f"n > {HELD} and lo < hi")
    while not opened.isEmpty():
        part = F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS).cast("int"))
        inside = rows.join(opened, rows["k"].eqNullSafe(opened["k"]) & F.col("v").between(F.col("lo"), F.col("hi"))).select(opened["k"], "rank", "before", "v", part.alias("bin"))
        counts = inside.groupBy("k", "rank", "before", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        # BINS rows at most for each wanted rank
        so_far = F.sum("n").over(W.partitionBy("k", "rank").orderBy("bin"))
        found = counts.withColumn("before", F.col("before") + so_far - F.col("n")).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        found = written(found.select("k", "rank", "lo", "hi", "before", "n"), "intervals")
        closed = closed.unionByName(found.where(f"n <= {HELD} or lo = hi"))
        opened = found.where(f"n > {HELD} and lo < hi")
    one = closed.where("lo = hi").select("k", "rank", F.col("lo").alias("value"))
    few = closed.where("lo < hi")
    held = rows.join(few, rows["k"].eqNullSafe(few["k"]) & F.col("v").between(F.col("lo"), F.col("hi"))).select(few["k"], "rank", "before", "v")
    held = held.groupBy("k", "rank", "before").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    return one.unionByName(held.select("k", "rank", F.get("vs", (F.col("rank") - F.col("before")).cast("int")).alias("value")))


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """keys, n, values: the number of values and the quantiles of each group, in the order of ``shares``."""
    given = rows.select(F.struct(*keys).alias("k"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    groups = written(given.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "groups")
    asked = groups.select("k", "n", "lo", "hi", F.posexplode(F.array(*map(F.lit, shares))).alias("at", "share")).withColumn("place", F.col("share") * (F.col("n") - 1))
    ends = asked.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))))
    targets = written(ends.select("k", "rank", "lo", "hi", F.lit(0).cast("long").alias("before"), "n").distinct(), "targets")
    found = written(ranked_values(given, targets), "ranked")
    low, high = (found.select(F.col("k").alias(f"k{x}"), F.col("rank").alias(f"r{x}"), F.col("value").alias(x)) for x in ("low", "high"))
    both = asked.join(low, asked["k"].eqNullSafe(F.col("klow")) & (F.floor("place") == F.col("rlow"))).join(high, asked["k"].eqNullSafe(F.col("khigh")) & (F.ceil("place") == F.col("rhigh")))
    between = F.when(F.floor("place") == F.ceil("place"), F.col("low")).otherwise((F.ceil("place") - F.col("place")) * F.col("low") + (F.col("place") - F.floor("place")) * F.col("high"))
    out = both.groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("at", between.alias("value")))).alias("x"))
    return out.select("k.*", "n", F.transform("x", lambda x: x["value"]).alias("values"))
