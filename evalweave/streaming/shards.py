"""Ingestion of feature shards as they arrive, each committed once, and pooling of bags meanwhile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str) -> None:
    """Append all Parquet shards of ``source`` that ``target`` hasn't got yet; running it again adds only new ones."""
    arriving = spark.readStream.schema(schema).parquet(source)
    query = arriving.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def sizes(spark: SparkSession, target: str, key: str, vector: str) -> DataFrame:
    """Rows and length of vectors of what has arrived, by key."""
    return spark.read.parquet(target).groupBy(key).agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dims"))


def pool(spark: SparkSession, source: str, schema: T.StructType, key: str, row: str, vector: str, target: str, checkpoint: str) -> None:
    """Add all shards that have arrived to the running sums of their bags.

    The stream's state holds, for each bag (``key``) and position of the vector, the sum and number
    of its rows, and the rows that have been seen, so a shard that is delivered twice counts once.
    Each micro-batch writes the bags that it changed to a folder of its own, which a repeated
    batch replaces.
    """
    arriving = spark.readStream.schema(schema).parquet(source).select(key, row, vector).dropDuplicates([key, row])
    each = arriving.select(F.col(key), F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    sums = each.groupBy(key, "pos").agg(F.sum("x").alias("sum"), F.count("*").alias("n"))

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    query = sums.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def pooled(spark: SparkSession, target: str, key: str, vector: str, parents: DataFrame | None = None) -> DataFrame:
    """Mean vector and number of rows of each bag by what has arrived; of ``parents`` (key), one without rows is an error."""
    last = spark.read.parquet(target).groupBy(key, "pos").agg(F.max_by(F.struct("sum", "n"), "batch").alias("s"))
    found = last.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("s.sum") / F.col("s.n")).alias("x")))), lambda c: c["x"]).alias(vector), F.max("s.n").alias("n"))
    if parents is None:
        return found
    joined = parents.join(found, key, "left")
    return joined.withColumn(vector, F.when(F.col(vector).isNull(), F.raise_error(F.concat(F.lit("no children: "), F.col(key).cast("string")))).otherwise(F.col(vector)))
