"""Token-id files: frequency-ranked ids, byte-aligned variable-length coding, separate control bytes (operator 5).

Format.  An id is replaced by its rank in the corpus-wide frequency order (0:
most frequent; ties: smaller id first).  A rank takes 1 to 4 little-endian data
bytes; its length less one takes two bits of a control byte, the first of four
ranks lowest.  Control bytes and data bytes are kept apart.  Each document
starts a new control byte.  A block row holds whole documents in ascending
doc_id order (nulls first; equal ids by text digest): their ids, their numbers
of ids, the two byte strings, and the ids before the block in its shard.
Shards ascend too.  The rank table is a file beside the blocks.  Decoding finds
lengths by a table of the 256 control bytes and gathers data bytes with numpy.

Null and empty texts have only the end id.  Texts of any length are encoded whole.
Repeated rows stay, in any order of equal texts.  An empty table gives no blocks.
Other columns of the documents play no part, whatever their names.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranges, shared_dir, shuffle_partitions, table, texts_of, tidied, written
from .tokens import encoder_for

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Data bytes after which a block is closed; a longer document makes a block of its own.
BLOCK_BYTES = 4 << 20
#: Length of each of the four ranks under a control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, data bytes and the numbers of both for documents of ``counts`` ranks each."""
    ranks = ranks.astype(np.uint32)
    size = np.ones(len(ranks), np.int64)
    for bound in (8, 16, 24):
        size += ranks >= np.uint32(1 << bound)
    n_control = (counts + 3) >> 2
    control = np.zeros(int(n_control.sum()), np.uint8)
    within = ranges(np.zeros(len(counts), np.int64), counts)
    slot = np.repeat(np.cumsum(n_control) - n_control, counts) + (within >> 2)
    for lane in range(4):
        at = (within & 3) == lane
        control[slot[at]] |= ((size[at] - 1) << (2 * lane)).astype(np.uint8)
    ends = np.cumsum(size)
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    start = ends - size
    for byte in range(4):
        at = size > byte
        data[start[at] + byte] = (ranks[at] >> np.uint32(8 * byte)).astype(np.uint8)
    total = np.concatenate(([0], ends))
    edges = np.concatenate(([0], np.cumsum(counts)))
    return control, data, n_control, total[edges[1:]] - total[edges[:-1]]


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranks of all documents of a block."""
    n_control = (counts + 3) >> 2
    lanes = LENGTHS[control].reshape(-1)
    used = ranges((np.cumsum(n_control) - n_control) * 4, counts)
    size = lanes[used].astype(np.int64)
    start = np.cumsum(size) - size
    out = data[start].astype(np.uint32)
    for byte in range(1, 4):
        at = np.flatnonzero(size > byte)
        out[at] |= data[start[at] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def tokenized(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, tie (digest of the text) and ids (little-endian, 2 bytes each where the vocabulary allows); a row of each task has counts of all its ids instead."""
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("ids", pa.binary()), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        kind = "<u2" if max(tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
        added = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        encoder = encoder_for(("word", vocabulary), lambda: tokenizer, "|".join(added) or "$^.", bare=True)  # added tokens are matched in the text as it is
        counts = np.zeros(max(tokenizer.get_vocab_size(), end_id + 1), np.int64)
        for batch in batches:
            for first, last, ids, at in encoder.batches(texts_of(batch.column(2))):
                n = last - first
                out = np.full(len(ids) + n, end_id, kind)
                where = at + np.arange(n + 1)
                out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
                counts += np.bincount(out, minlength=len(counts))
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((where * out.itemsize).astype(np.int32)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), raw, pa.nulls(n, schema.types[3])], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, counts), schema.types)], schema=schema)

    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long"), F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(tidied(run), "doc_id long, tie long, ids binary, counts array<long>")


def id_counts(tokens: DataFrame) -> DataFrame:
    """How often each id occurs, over all documents."""
    return tokens.where("counts is not null").select(F.posexplode("counts").alias("token_id", "n")).where("n > 0").groupBy("token_id").agg(F.sum("n").alias("n"))


def write_token_file(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Tokenize ``docs`` (doc_id, text) and write ``path``/ranks and ``path``/blocks."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    most = max(Tokenizer.from_file(vocabulary).get_vocab_size() - 1, end_id)
    width = 2 if most < 1 << 16 else 4
    tokens = written(tokenized(docs, vocabulary, end_id), "ids")
    # at most one row per id of the vocabulary comes to the driver
    found = sorted(((-r["n"], r["token_id"]) for r in id_counts(tokens).collect()))
    order = [i for _, i in found]
    spark.createDataFrame([(rank, i, -n) for rank, (n, i) in enumerate(found)], "rank long, token_id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(most + 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)
    doc_schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("control", pa.binary()), ("data", pa.binary())])
    binary = lambda data, sizes: pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.py_buffer(data)])

    def pack_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = batch.column(2), 0
            sizes = np.fromiter((len(x.as_buffer()) for x in raw), np.int64, len(raw))
            while at < len(raw):  # in slices, as a batch may be large
                to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK_BYTES)) + at)
                ids = np.frombuffer(b"".join(x.as_py() for x in raw.slice(at, to - at)), f"<u{width}")
                counts = sizes[at:to] // width
                control, data, n_control, n_data = pack(shared.value[ids], counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(counts), binary(control, n_control), binary(data, n_data)], schema=doc_schema)
                at = to

    block_schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("ids_before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])

    def make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, counts, control, data, size = [], [], [], [], 0

        def close():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([shard], [block], [before], [doc_ids], [counts], [b"".join(control)], [b"".join(data)]), block_schema.types)], schema=block_schema)

        for batch in batches:
            for doc_id, _, n, c, d in zip(*(x.to_pylist() for x in batch.columns)):
                doc_ids.append(doc_id)
                counts.append(n)
                control.append(c)
                data.append(d)
                size += len(d)
                if size >= BLOCK_BYTES:
                    yield close()
                    before, block = before + sum(counts), block + 1
                    doc_ids, counts, control, data, size = [], [], [], [], 0
        if doc_ids:
            yield close()

    # ids are packed after they have been dealt, as dealing by range runs what comes before it twice
    keys = (F.col("doc_id").asc_nulls_first(), F.col("tie").asc())
    ordered = tokens.where("counts is null").select("doc_id", "tie", "ids").repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    blocks = ordered.mapInArrow(tidied(lambda batches: make_blocks(pack_docs(batches))), "shard long, block long, ids_before long, doc_ids array<long>, counts array<long>, control binary, data binary")
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")
    shared.unpersist()


def read_token_file(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (``with_ids``) the ids of each document."""
    ranks = spark.read.parquet(f"{path}/ranks").select("rank", "token_id").collect()
    id_of = np.zeros(len(ranks), "<u4")
    for r in ranks:
        id_of[r["rank"]] = r["token_id"]
    blocks = spark.read.parquet(f"{path}/blocks")
    # one total per shard comes to the driver: as many as the writer had partitions
    totals = {r["shard"]: r["n"] for r in blocks.select("shard", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    ahead, so_far = {}, 0
    for shard in sorted(totals):
        ahead[shard], so_far = so_far, so_far + totals[shard]
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, before = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                doc_ids, counts = batch.column(2)[i].values, batch.column(3)[i].values.to_numpy()
                control, data = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint8) for k in (4, 5))
                ids = id_of[unpack(control, data, counts)]
                at = np.concatenate(([0], np.cumsum(counts)))
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), at[1:].tolist())]
                out = [doc_ids, pa.array(ahead[shard] + before + at[:-1]), pa.array(counts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(out + ([pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)))] if with_ids else []), schema=schema)

    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return blocks.select("shard", "ids_before", "doc_ids", "counts", "control", "data").mapInArrow(tidied(run), out)


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-file-{uuid.uuid4().hex}"
    write_token_file(table(spark, sf_dir, "documents"), path)
    return read_token_file(spark, path, with_ids=False)
