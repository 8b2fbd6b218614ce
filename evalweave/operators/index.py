"""Indexes of labelled items: classes, names, look-ups, validation and content signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def class_codes(items: DataFrame, name: str = "class_name", code: str = "label") -> DataFrame:
    """Adds the position of each class in the sorted list of classes; null classes get null."""
    classes = items.select(name).where(F.col(name).isNotNull()).distinct()
    coded = classes.withColumn(code, (F.row_number().over(W.orderBy(name)) - 1).cast("int"))  # a row for each class
    return items.join(coded, name, "left")


def strict_lookup(items: DataFrame, lookup: DataFrame, on: list[str] | str, need: str) -> DataFrame:
    """Left join in which a missing partner is an error, raised when the rows are read."""
    keys = [on] if isinstance(on, str) else on
    shown = F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))
    joined = items.join(lookup, keys, "left")
    return joined.withColumn(need, F.when(F.col(need).isNull(), F.raise_error(F.concat(F.lit(f"no {need} for "), shown))).otherwise(F.col(need)))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, that of the largest ``order``."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("row"))
    return best.select(key, *(F.col(f"row.{c}").alias(c) for c in others))


def patient_of(name: Column) -> Column:
    """Leading digits of a file name's third part between dashes."""
    return F.regexp_extract(F.get(F.split(name, "-"), F.lit(2)), r"^\d+", 0)


def slide_of(name: Column, parts: int = 2) -> Column:
    return F.substring_index(name, "_", parts)


def tile_name(stem: Column) -> Column:
    """Slide and position of a tile from ``slide_x_y``; other names are an error."""
    p = F.split(stem, "_")
    checked = F.when(F.size(p) != 3, F.raise_error(F.concat(F.lit("not a tile name: "), stem))).otherwise(p)
    return F.struct(F.get(checked, F.lit(0)).alias("slide"), F.get(checked, F.lit(1)).cast("int").alias("x"), F.get(checked, F.lit(2)).cast("int").alias("y"))


def one_hot_label(*flags: Column) -> Column:
    """Position of the only 1 among flags; none or several are an error."""
    a = F.array(*flags)
    return F.when(F.size(F.filter(a, lambda x: x == 1)) != 1, F.raise_error(F.lit("not exactly one class"))).otherwise(F.array_position(a, 1) - 1).cast("int")


def repeated(items: DataFrame, key: Column | str) -> DataFrame:
    """Keys of several rows, with their number."""
    return items.groupBy(F.col(key).alias("key") if isinstance(key, str) else key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def group_count(groups: str) -> Column:
    """Distinct groups, the empty text not counted."""
    return F.countDistinct(F.nullif(F.col(groups), F.lit("")))


def content_hash(rows: DataFrame, order: str, value: Column, block: int = 1024) -> DataFrame:
    """SHA-256 over a column in the order of a whole-number key: of each block of keys, then of the blocks' digests.

    A block's text is its values in order, each closed by a line end; blocks are
    hashed where they are, so no task sees the whole column.
    """
    lines = rows.select(F.floor(F.col(order) / block).alias("block"), F.struct(F.col(order), F.coalesce(value.cast("string"), F.lit("")).alias("v")).alias("x"))
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]), "\n"), F.lit("\n"))
    blocks = lines.groupBy("block").agg(F.sha2(text, 256).alias("digest"))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"]), "\n")
    return blocks.agg(F.sha2(F.concat(top, F.lit("\n")), 256).alias("content_hash"), F.count("*").alias("n_blocks"))


def data_signature(index: DataFrame, threshold: float | None) -> DataFrame:
    """Sixteen digits over the filter and the path, label, group and partition columns of an index, in its order.

    The layout is the printed filter, then each column joined by line ends, with
    nothing between columns.
    """
    kept = f"{{'tissue_min': {threshold}}}"
    column = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", F.col(c).cast("string").alias("v")))), lambda x: x["v"]), "\n")
    return index.agg(F.substring(F.sha2(F.concat(F.lit(kept), *(column(c) for c in ("path", "label", "grp", "part"))), 256), 1, 16).alias("signature"))


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Units that aren't done with an equal signature."""
    return wanted.join(done.select(*keys, "signature"), [*keys, "signature"], "left_anti")


def external_signature(external: DataFrame, probe_signature: str, c: float) -> DataFrame:
    """Sixteen digits over a probe's signature, its C, and path and label of an external set (row_id, path, label) in order."""
    rows = content_hash(external, "row_id", F.concat_ws(":", "path", F.col("label").cast("string")))
    return rows.select(F.substring(F.sha2(F.concat_ws("\n", F.lit(probe_signature), F.lit(repr(c)), "content_hash"), 256), 1, 16).alias("signature"))
