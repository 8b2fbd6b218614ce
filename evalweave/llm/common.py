"""Helpers that several operators share: tables, shared storage, byte-level text handling."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker handles at a time, so that its memory doesn't follow the size of Spark's batches.
SLICE_BYTES = 4 << 20


def tidy() -> None:
    """Give freed memory back, as a worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(f):
    """A function over a task's batches that gives memory back at its end."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            tidy()

    return run


def tidied_group(f):
    """The same for a function of a group's table."""

    def run(rows: pa.Table) -> pa.Table:
        try:
            return f(rows)
        finally:
            tidy()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one of our own, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value, f):
    """f of a column that is computed once, though f may use it often."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def crc_mod(column, n: int):
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """A plain string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def raw_of(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array."""
    n = len(column)
    _, offsets, data = column.buffers()
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(column: pa.StringArray, most: int = SLICE_BYTES):
    """(first, last) row ranges of at most ``most`` bytes, or of one text if that is longer."""
    _, offsets = raw_of(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last
        first = last


WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything in ASCII but letters and digits.
SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(column: pa.StringArray, between: np.ndarray = WHITE) -> tuple[pa.BinaryArray, np.ndarray]:
    """All words (runs of bytes that aren't ``between``) with A-Z in lower case, and the index of each text's first word (one more at the end)."""
    data, offsets = raw_of(column)
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(column) + 1, np.int64)
    white = between[data]
    edge = np.ones(len(data), bool)
    edge[1:] = white[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    edge[inner] = True
    starts = np.flatnonzero(edge & ~white)
    stop = np.ones(len(data), bool)
    stop[:-1] = white[1:]
    ends_at = offsets[1:] - 1
    stop[ends_at[ends_at >= 0]] = True
    ends = np.flatnonzero(stop & ~white) + 1
    lengths = ends - starts
    # the kept bytes are exactly the non-white ones, in order
    kept = LOWER[data[~white]]
    word_offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(word_offsets), pa.py_buffer(kept)])
    return words, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of start, start + 1, ... for each pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def hash_bytes(words: pa.BinaryArray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each value."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
