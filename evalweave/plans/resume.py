"""Incremental runs: only units whose result is missing or was made from other inputs are made again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.index import pending
from ..sources import storage
from ..sources import units as store


def run_pending(wanted: DataFrame, done: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame], path: str) -> int:
    """Make the pending units, put their rows in place of what ``path`` has of them, and give their number.

    ``make`` gives rows with the keys of the units it is given.  Rows are published unit by unit
    with their signature when all of them are made, so a run that fails can be made again.
    """
    units = storage.written(pending(wanted, done, keys), "pending")
    n = units.count()
    if n:
        signed = units.select(*keys, F.col("signature").alias("_signature"))
        rows = make(units).join(signed, keys).withColumn("_unit", F.to_json(F.struct(*keys)))
        store.write_units(rows, path, "_unit", signed="_signature")
    return n


def done_units(spark, path: str, schema: str) -> DataFrame:
    """Keys and signature of the units that ``path`` has; ``schema``: that of the keys."""
    return store.published(spark, path).select(F.from_json(F.get_json_object(F.concat(F.lit('{"u":'), "unit", F.lit("}")), "$.u"), schema).alias("k"), "signature").select("k.*", "signature")


def results(spark, path: str) -> DataFrame:
    """Rows of all units."""
    return store.read_units(spark, path).drop("_unit", "_signature")
