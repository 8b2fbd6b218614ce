"""Byte-level BPE encoding and decoding over Arrow batches (operator 9).

``encode_decode`` keeps one row per input row.  Null and empty texts have no
ids.  Texts of any length are encoded whole.  Repeated rows give repeated rows;
other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts_of, tidied
from .tokens import WIDE_SPACE, ByteDecoder, byte_bpe, encoder_for

RANKS = "byte_bpe_multi_50k.tiktoken"


def coder(ranks_path: str, pattern: str, make: Callable, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        encoder = encoder_for(("byte", ranks_path, pattern), lambda: byte_bpe(ranks_path, pattern), WIDE_SPACE)
        decoder = ByteDecoder.of(encoder.tokenizer)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for first, last, ids, at in encoder.batches(texts):
                columns = make(ids, at, decoder, texts.slice(first, last - first))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *columns], schema=schema)

    return run


def encode_decode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array), start and end byte of each id's bytes in the text, decoded text."""
    from pyspark.sql.pandas.types import to_arrow_type

    ranks_path, pattern = ranks_path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    schema = pa.schema([("id", to_arrow_type(docs.schema[id_col].dataType)), ("ids", pa.list_(pa.int32())), ("byte_start", pa.list_(pa.int32())), ("byte_end", pa.list_(pa.int32())), ("decoded", pa.string())])

    def make(ids, at, decoder, texts):
        size = decoder.length[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        base = np.repeat(ends[at[:-1]], np.diff(at))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32()))
        data, where = decoder.decode(ids, at)
        raw = data.tobytes()
        return [lists(ids), lists(ends[:-1] - base), lists(ends[1:] - base), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(where, where[1:])], pa.string())]

    out = f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, byte_start array<int>, byte_end array<int>, decoded string"
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidied(coder(ranks_path, pattern, make, schema)), out).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: digests of the ids and of the bytes decoded from them."""
    ranks_path, pattern = ranks_path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def make(ids, at, decoder, texts):
        data, where = decoder.decode(ids, at)
        ids, data, sha = memoryview(ids.astype("<u4")).cast("B"), memoryview(data), hashlib.sha256
        return [
            pa.array(np.diff(at), pa.int64()),
            pa.array([sha(ids[4 * a : 4 * b]).hexdigest() for a, b in zip(at.tolist(), at[1:].tolist())], pa.string()),
            pa.array([sha(data[a:b]).hexdigest() for a, b in zip(where.tolist(), where[1:].tolist())], pa.string()),
        ]

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(tidied(coder(ranks_path, pattern, make, schema)), out)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
