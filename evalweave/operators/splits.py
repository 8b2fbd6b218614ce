"""Splits without group leakage, decided by hashes: the same in any engine and for any number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import hash_text

HELD_OUT = 0.2


def ranked(items: DataFrame, digest: Column, tie: str, by: str | None = None) -> DataFrame:
    """Adds rank (from 1, by a hexadecimal digest, then ``tie``) and n among all rows or those of equal ``by``.

    Rows are ranked among those whose digests begin alike; how many come before
    follows from counts, so no task orders all rows of a class.
    """
    key = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    rows = items.withColumns({"_digest": digest, "_key": key, "_null": F.col(by).isNull() if by else F.lit(False)}).withColumn("_begin", F.substring("_digest", 1, 3))
    begins = rows.groupBy("_key", "_null", "_begin").agg(F.count("*").alias("_n"))  # 4096 of a class at most
    of_class = W.partitionBy("_key", "_null")
    begins = begins.select("_key", "_null", "_begin", (F.sum("_n").over(of_class.orderBy("_begin")) - F.col("_n")).alias("_before"), F.sum("_n").over(of_class).alias("n"))
    within = F.row_number().over(W.partitionBy("_key", "_null", "_begin").orderBy("_digest", tie))
    out = rows.withColumn("_within", within).join(begins, ["_key", "_null", "_begin"]).withColumn("rank", F.col("_before") + F.col("_within"))
    return out.select(*items.columns, "rank", "n")


def held_out_groups(groups: DataFrame, seed: int | str, share: float = HELD_OUT) -> DataFrame:
    """``groups`` (grp: distinct) with test: the first fifth (rounded up) by hash."""
    found = ranked(groups.select("grp"), hash_text(seed, F.col("grp")), "grp")
    return found.select("grp", (F.col("rank") <= F.ceil(F.round(F.col("n") * F.lit(share), 9))).alias("test"))


def group_split(items: DataFrame, seed: int) -> DataFrame:
    """``items`` (row_id, grp) with part: a fifth of the groups is test, a fifth of the others val."""
    groups = items.select("grp").distinct()
    outer = held_out_groups(groups, seed)
    inner = held_out_groups(outer.where(~F.col("test")).select("grp"), f"{seed}:val").withColumnRenamed("test", "val")
    parts = outer.join(inner, "grp", "left").select("grp", F.when(F.col("test"), "test").when(F.col("val"), "val").otherwise("train").alias("part"))
    return items.join(parts, "grp")


def stratified_part(items: DataFrame, seed: int | str, label: str = "label", share: float = HELD_OUT) -> DataFrame:
    """Adds held: a fifth (rounded) of each class, by hash."""
    found = ranked(items, hash_text(seed, F.col("row_id")), "row_id", label)
    return found.withColumn("held", F.col("rank") <= F.floor(F.col("n") * F.lit(share) + F.lit(0.5))).drop("rank", "n")


def stratified_split(items: DataFrame, seed: int) -> DataFrame:
    """``items`` (row_id, label) with part, for items without groups."""
    outer = stratified_part(items, seed)
    rest = stratified_part(outer.where(~F.col("held")).drop("held"), f"{seed}:val")
    inner = rest.withColumn("part", F.when(F.col("held"), "val").otherwise("train")).drop("held")
    return outer.where("held").drop("held").withColumn("part", F.lit("test")).unionByName(inner)


def split_rows(items: DataFrame, seed: int, official: bool = False) -> DataFrame:
    """Official parts as they are; else by groups if any is not empty and there are several, else stratified."""
    if official:
        missing = {"train", "val", "test"} - {r["part"] for r in items.select("part").distinct().collect()}
        if missing:
            raise ValueError(f"official partition incomplete: {sorted(missing)}")
        return items.where(F.col("part").isin("train", "val", "test"))
    items = items.drop("part")
    row = items.agg(F.max(F.col("grp") != "").alias("any"), F.countDistinct("grp").alias("n")).first()
    return group_split(items, seed) if row["any"] and row["n"] > 1 else stratified_split(items, seed)


def image_split(items: DataFrame, seed: int, official: bool = False) -> DataFrame:
    """The stratified split of single rows, whatever their groups, which shows what leakage does; official parts have none."""
    if official:
        raise ValueError("an official partition has no split by rows")
    return split_rows(items.withColumn("grp", F.lit("")), seed)


def manifest(index: DataFrame, parts: DataFrame) -> DataFrame:
    """All rows of the index with their part; rows that weren't split are excluded."""
    return index.join(parts.select("row_id", "part"), "row_id", "left").withColumn("part", F.coalesce("part", F.lit("excluded")))


def leaks(split: DataFrame) -> DataFrame:
    """Groups of the test part that occur in train or val too; train and val may share some."""
    groups = split.where("grp <> ''").select("grp", "part").distinct()
    return groups.where("part = 'test'").select("grp").intersect(groups.where("part <> 'test'").select("grp"))


def sample_fixed(items: DataFrame, n: int, seed: int, key: str = "row_id") -> DataFrame:
    """The n rows of the smallest hashes."""
    return items.orderBy(hash_text(seed, F.col(key)), key).limit(n)


def subset_evenly(items: DataFrame, n: int) -> DataFrame:
    """Rows at n evenly spaced positions, both ends included; row_id counts rows from 0."""
    count = items.agg((F.max("row_id") + 1).alias("rows"))
    at = count.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "rows")
    wanted = at.select(F.bround(F.try_divide(F.col("i") * (F.col("rows") - 1).cast("double"), F.lit(float(n - 1))), 0).cast("long").alias("row_id")).distinct()
    return items.join(wanted, "row_id", "left_semi")
