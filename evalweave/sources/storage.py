"""Tables of a data folder, shared storage for intermediate results, and the index reader with its empty-text rule."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "tif", "tiff")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one of our own, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of all files under a path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    one = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    r = files.select("path", "length", "modificationTime").agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.sum(one).alias("sum")).first()
    return f"{r['n']}:{r['size']}:{r['sum']}"


_ONCE: dict[tuple[str, str, str, str], tuple[str, T.StructType]] = {}


def once(spark: SparkSession, sf_dir: str, label: str, make: Callable[[], DataFrame], tables: tuple[str, ...] = ("embeddings",)) -> DataFrame:
    """A written table that an application builds once for the present files of some tables of a data folder, as long as its own files are there."""
    now = " ".join(state(spark, f"{sf_dir}/{t}.parquet") for t in tables)
    key = (spark.sparkContext.applicationId, sf_dir, label, now)
    path = _ONCE[key][0] if key in _ONCE else f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if key not in _ONCE or not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df = make()
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        _ONCE[key] = (path, df.schema)
    return spark.read.schema(_ONCE[key][1]).parquet(path)


def read_index(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV index with a header and an explicit schema; empty fields of text columns stay empty texts, never nulls."""
    rows = spark.read.schema(schema).csv(path, header=True)
    return rows.na.fill("", [f.name for f in rows.schema if isinstance(f.dataType, T.StringType)])


def write_index(index: DataFrame, path: str, compression: str = "none") -> None:
    """CSV sorted by path; a repeated path is an error."""
    counted = index.groupBy("path").count().where("count > 1").limit(1).collect()
    if counted:
        raise ValueError(f"repeated path: {counted[0]['path']}")
    index.orderBy("path").write.option("compression", compression).csv(path, header=True)


def walk_images(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """Paths of all images under a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path").where(F.lower("path").rlike(rf"\.({'|'.join(suffixes)})$"))


def write_shards(features: DataFrame, path: str, shard_rows: int = 4096) -> None:
    """Feature rows in shards by row_id; a null, empty or non-finite vector is an error."""
    vectors = [f.name for f in features.schema if isinstance(f.dataType, T.ArrayType)]
    for v in vectors:
        bad = F.col(v).isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        features = features.withColumn(v, F.when(bad, F.raise_error(F.concat(F.lit(f"bad {v} in row "), F.col("row_id").cast("string")))).otherwise(F.col(v)))
    features.repartitionByRange("row_id").sortWithinPartitions("row_id").write.option("maxRecordsPerFile", shard_rows).parquet(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of each file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))
