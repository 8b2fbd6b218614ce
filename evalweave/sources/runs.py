"""Stores of predictions, run records, features and statistics, their checks, and what is stale in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.index import content_hash
from . import units
from .storage import write_shards

UNIT = ("model", "dataset", "seed")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions by model, data set and seed; probabilities in single precision."""
    predictions.withColumn("probs", F.col("probs").cast("array<float>")).write.partitionBy(*UNIT).parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of the seeds that every model of a data set has."""
    rows = spark.read.parquet(path)
    units = rows.select(*UNIT).distinct()
    models = units.groupBy("dataset").agg(F.countDistinct("model").alias("models"))
    shared = units.groupBy("dataset", "seed").agg(F.countDistinct("model").alias("models")).join(models, ["dataset", "models"], "left_semi")
    return rows.join(shared.select("dataset", "seed"), ["dataset", "seed"], "left_semi")


def write_records(records: DataFrame, path: str) -> None:
    """Run records as JSON lines by model, data set and seed."""
    records.write.partitionBy(*UNIT).json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Run records with model, dataset and seed from their folders; and path and text of those that can't be read."""
    kept = T.StructType.fromDDL(schema)
    full = T.StructType([*kept.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).withColumn("path", F.input_file_name())
    rows = lines.withColumn("x", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return rows.where("x._corrupt is null").select(*UNIT, *(f"x.{f.name}" for f in kept)), rows.where("x._corrupt is not null").select("path", "value")


def record_of(records: DataFrame, **key) -> DataFrame:
    """The one record of a key; none or several are an error when it is read."""
    found = records
    for name, value in key.items():
        found = found.where(F.col(name) == value)
    n = found.agg(F.count("*").alias("_n"))  # one row
    checked = n.select(F.when(F.col("_n") == 1, F.lit(0)).otherwise(F.raise_error(F.concat(F.lit(f"not exactly one record of {key}: "), F.col("_n").cast("string"))).cast("int")).alias("_odd"))
    return checked.where("_odd = 0").join(found).drop("_odd")


def write_features(features: DataFrame, path: str, index_hash: str, shard_rows: int = 4096) -> None:
    """Shards of features and, when they are complete, a mark with the hash of the index they were made from."""
    write_shards(features, f"{path}/shards", shard_rows)
    features.sparkSession.createDataFrame([(index_hash,)], "index_hash string").coalesce(1).write.json(f"{path}/done")


def load_features(spark: SparkSession, path: str, index: DataFrame, label: str = "label") -> DataFrame:
    """``index`` (row_id, ...) with its features, one for one; unfinished or foreign features are an error."""
    done = [r["index_hash"] for r in spark.read.schema("index_hash string").json(f"{path}/done").collect()]  # one row
    if done != [content_hash(index, "row_id", F.col(label)).first()["content_hash"]]:
        raise ValueError(f"{path} was made from another index")
    return one_to_one(index, spark.read.parquet(f"{path}/shards"), "row_id")


def write_feature_units(features: DataFrame, path: str, index_hash: str, shard_rows: int = 4096) -> None:
    """Features (row_id, ...) as one unit in shards by row_id, published whole with the hash of the index they were made from."""
    units.write_units(features, path, None, index_hash, order="row_id", shard=shard_rows)


def scan_features(spark: SparkSession, path: str, index: DataFrame, label: str = "label", first: int | None = None, last: int | None = None) -> DataFrame:
    """Features of ``index`` within a range of row_id, of the shards that have any of it.

    Unfinished features, and those of another index, are an error before anything is read.
    """
    mark = content_hash(index, "row_id", F.col(label)).first()["content_hash"]
    rows = units.read_units(spark, path, mark, first=first, last=last)
    for end, test in ((first, F.col("row_id") >= F.lit(first)), (last, F.col("row_id") <= F.lit(last))):
        rows = rows if end is None else rows.where(test)
    return rows


def write_tile_index(tiles: DataFrame, path: str) -> None:
    """A tile index (row_id, path, ...) with the hash of its paths as its mark."""
    units.write_units(tiles, path, None, content_hash(tiles, "row_id", F.col("path")).first()["content_hash"], order="row_id")


def load_tile_index(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The tile index of a folder; one that is unfinished, or whose rows aren't those of its mark, is an error.

    ``name``: queries find the table by this name from now on, instead of any other.
    """
    rows = units.read_units(spark, path)
    stated = [r["signature"] for r in units.published(spark, path).collect()]  # one row
    if stated != [content_hash(rows, "row_id", F.col("path")).first()["content_hash"]]:
        raise ValueError(f"{path}: the tile index does not match its mark")
    if name:
        rows.createOrReplaceTempView(name)
    return rows


def one_to_one(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Join in which every row of either side must have exactly one partner; anything else is an error when rows are read."""
    sides = left.select(on).withColumn("l", F.lit(1)).unionByName(right.select(on).withColumn("l", F.lit(0)))
    odd = sides.groupBy(on).agg(F.sum("l").alias("l"), F.count("*").alias("n")).where("l <> 1 or n <> 2")
    checked = odd.limit(1).agg(F.count("*").alias("odd")).select(F.when(F.col("odd") > 0, F.raise_error(F.lit("rows without exactly one partner"))).otherwise(F.lit(0)).alias("_odd"))
    return left.join(right, on).join(F.broadcast(checked)).where("_odd = 0").drop("_odd")  # one row


def signatures(runs: DataFrame, decimals: int = 9) -> DataFrame:
    """dataset, model, signature: a digest of the values of each model's runs, whatever their order."""
    line = F.concat_ws(":", F.col("seed").cast("string"), "metric", F.format_number("value", decimals))
    return runs.groupBy("dataset", "model").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("signature"))


def write_stats(intervals: DataFrame, tests: DataFrame, runs: DataFrame, path: str) -> None:
    """Statistics as tables, with the signatures of the runs they were made from."""
    intervals.write.option("header", True).csv(f"{path}/ci")
    tests.write.option("header", True).csv(f"{path}/tests")
    signatures(runs).write.json(f"{path}/signatures")


def freshness(spark: SparkSession, path: str, runs: DataFrame) -> DataFrame:
    """dataset, model, state of each model of the runs: fresh, stale (made from other runs) or missing."""
    stated = spark.read.schema("dataset string, model string, signature string").json(f"{path}/signatures").withColumnRenamed("signature", "stated")
    state = F.when(F.col("stated").isNull(), "missing").when(F.col("stated") == F.col("signature"), "fresh").otherwise("stale")
    return signatures(runs).join(stated, ["dataset", "model"], "left").select("dataset", "model", state.alias("state"))


def scan_or_skip(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, str | None]:
    """A CSV table and None; where there is none, no rows and a note on what was skipped."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema), f"skipped: {path}"
    return spark.read.schema(schema).csv(path, header=True), None
