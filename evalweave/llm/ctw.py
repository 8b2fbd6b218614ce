"""Language-model scoring by context-tree weighting over bytes (operator 7).

Training counts all n-grams of the training texts and shuffles them as sorted
arrays by their ``SPLIT`` most recent context bytes, so that whole subtrees of
the context tree meet, each in a bucket of bounded size.  There the subtrees are
weighed bottom-up; their counts stay in the shared folder, all of them, however
many the corpus has.  Only the levels above the subtrees (contexts of less than
``SPLIT`` bytes) come to the driver and go to the tasks.

Scoring sends the distinct n-grams of each batch of texts to the buckets, which
weigh their subtrees once more and answer with code lengths; the batch adds them
up by text.  No model has to fit a worker, and no node is left out.

Every decision is coded by the mixture over all depths of its context down to
the deepest one seen in training; what the weights leave to unseen children goes
to that deepest node's own estimate, so the code is a proper one.

Words are counted by their 64-bit hashes, again as arrays: a batch of texts
sends its distinct words to their buckets and gets the corpus counts back.

The text that is scored is its tokens: lower-cased words with one space between,
closed by the end symbol.

Null and empty texts have one token, the end, and the end symbol's code length.
Texts of any length are scored whole, in memory that follows the longest one.
Rows with a null id count as ids of empty text.  Repeated rows are scored and
counted each.  Without training texts every bit costs one bit and the base score
is 0.  An empty table gives no rows.  Extra columns play no part, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, hash_bytes, mix, raw_of, shuffle_partitions, slices, table, texts_of, tidied, tidied_group, tidy, words_of, written
from .ctw_core import Model, add_up, count_ngrams, ngram_keys, pad_texts, runs, shorten, text_sums, weigh_up

DEPTH = 6
#: Context bytes that the n-grams of a bucket share at least.
SPLIT = 3
#: Bytes of text for each bucket of n-grams, about.
BUCKET_BYTES = 8 << 20
#: Groups in which the level above the subtrees is added up.
SHARDS = 4
#: Bytes of text in a stored batch.
BATCH_BYTES = 4 << 20
#: Distinct n-grams that a task holds before it adds equal ones up.
HELD_NGRAMS = 4_000_000


def batched(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, held_out, text) in stored batches of whole texts, which later passes read as they are."""
    schema = pa.schema([("batch_id", pa.int64()), ("n_bytes", pa.int64()), ("train_docs", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("ends", pa.list_(pa.int64())), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = texts_of(batch.column(2))
            for first, last in slices(texts, BATCH_BYTES):
                data, at = raw_of(texts.slice(first, last - first))
                held = batch.column(1).slice(first, last - first)
                train = ~held.to_numpy(zero_copy_only=False)
                row = (number, len(data), int(train.sum()), batch.column(0).slice(first, last - first).to_pylist(), held.to_pylist(), at[1:].tolist(), compressed(data.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)
                number += 1

    out = "batch_id long, n_bytes long, train_docs long, doc_ids array<long>, held_out array<boolean>, ends array<long>, text binary"
    return written(docs.select(docs["doc_id"].cast("long"), docs["held_out"], F.coalesce(docs["text"].cast("string"), F.lit(""))).mapInArrow(tidied(run), out), "ctw-texts")


def compressed(raw: bytes) -> bytes:
    """For texts and arrays that are shuffled: half the size that Spark's own compression gives."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw)


def plain(raw: pa.Buffer) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def strings_of(text: pa.Buffer, ends: np.ndarray) -> pa.StringArray:
    """Texts of a stored batch."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(plain(text)))


def rendered(texts: pa.StringArray) -> list[bytes]:
    """Each text as its tokens: lower-cased words with a space between."""
    words, at = words_of(texts)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), words), b" ").to_pylist()


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers as planes of bytes, which compress well; ascending ones are given as their differences."""
    return compressed(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes())


def expanded(raw: pa.Buffer, kind: type = np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(plain(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def ngram_rows(stored: DataFrame, depth: int, buckets: int) -> DataFrame:
    """bucket, keys, counts: the distinct n-grams of a task's training texts, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for text, ends, out in zip(*(batch.column(i) for i in range(3))):
                texts = strings_of(text.as_buffer(), ends.values.to_numpy())
                texts = texts.filter(pa.array(~out.values.to_numpy(zero_copy_only=False)))
                for first, last in slices(texts):
                    held.append(count_ngrams(rendered(texts.slice(first, last - first)), depth))
                    if len(held) > 1 and sum(len(k) for k, _ in held) > HELD_NGRAMS:
                        held = [add_up(*map(np.concatenate, zip(*held)))]
        if held:
            keys, counts = add_up(*map(np.concatenate, zip(*held)))
            order, edges = dealt(keys >> np.uint64(8 * (depth + 1 - SPLIT)), buckets)
            for b in np.flatnonzero(np.diff(edges)):
                own = order[edges[b] : edges[b + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([squeezed(np.diff(keys[own], prepend=np.uint64(0)))]), pa.array([squeezed(counts[own])])], names=["bucket", "keys", "counts"])

    return stored.where("train_docs > 0").select("text", "ends", "held_out").mapInArrow(tidied(run), "bucket long, keys binary, counts binary")


def asked_rows(stored: DataFrame, depth: int, buckets: int) -> DataFrame:
    """bucket, batch_id, keys: the distinct n-grams of each batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for batch_id, text, ends in zip(*(batch.column(i) for i in range(3))):
                keys = ngram_keys(pad_texts(rendered(strings_of(text.as_buffer(), ends.values.to_numpy())), depth)[0], depth)
                keys.sort()
                keys = runs(keys)[0]
                order, edges = dealt(keys >> np.uint64(8 * (depth + 1 - SPLIT)), buckets)
                for b in np.flatnonzero(np.diff(edges)):
                    own = order[edges[b] : edges[b + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([batch_id.as_py()], pa.int64()), pa.array([squeezed(np.diff(keys[own], prepend=np.uint64(0)))])], names=["bucket", "batch_id", "keys"])

    return stored.select("batch_id", "text", "ends").mapInArrow(tidied(run), "bucket long, batch_id long, keys binary")


def unpacked(keys: pa.ChunkedArray, counts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, and the sums of their counts."""
    return add_up(np.concatenate([np.cumsum(expanded(x.as_buffer())) for x in keys]), np.concatenate([expanded(x.as_buffer()).astype(np.int64) for x in counts]))


def fit(stored: DataFrame, depth: int, buckets: int) -> tuple[DataFrame, dict]:
    """All n-gram counts of the training texts by bucket (a table in the shared folder), and the levels above the buckets' subtrees."""

    def subtree(rows: pa.Table) -> pa.Table:
        keys, counts = unpacked(rows.column("keys"), rows.column("counts"))
        out = [("grams", rows.column("bucket")[0].as_py(), squeezed(np.diff(keys, prepend=np.uint64(0))), squeezed(counts))]
        level = weigh_up(keys, counts, depth, SPLIT)[-1]
        above = [("counts", level["keys"], level["counts"])] + [(f"weighted{j}", *x) for j, x in enumerate(level["weighted"])]
        for kind, at, values in above:
            at, values = add_up(shorten(at), values)
            order, edges = dealt(at >> np.uint64(8), SHARDS)
            for shard in np.flatnonzero(np.diff(edges)):
                own = order[edges[shard] : edges[shard + 1]]
                out.append((kind, int(shard), at[own].tobytes(), values[own].tobytes()))
        return pa.table(dict(zip(("kind", "bucket", "a", "b"), map(list, zip(*out)))), schema=pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary())]))

    def added(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind")[0].as_py()
        at = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("a")])
        at, values = add_up(at, np.concatenate([np.frombuffer(x.as_buffer(), np.int64 if kind == "counts" else np.float64) for x in rows.column("b")]))
        return pa.table({"kind": [kind], "a": pa.array([at.tobytes()], pa.binary()), "b": pa.array([values.tobytes()], pa.binary())})

    grams = ngram_rows(stored, depth, buckets)
    table_ = written(grams.groupBy("bucket").applyInArrow(tidied_group(subtree), "kind string, bucket long, a binary, b binary"), "ctw-grams")
    above = table_.where("kind <> 'grams'").groupBy("kind", "bucket").applyInArrow(tidied_group(added), "kind string, a binary, b binary").toArrow()  # contexts of SPLIT - 1 bytes

    def level(kind: str, dtype: type) -> tuple[np.ndarray, np.ndarray]:
        rows = above.filter(pc.equal(above.column("kind"), kind))
        at, values = (np.concatenate([np.zeros(0, t), *(np.frombuffer(x.as_buffer(), t) for x in rows.column(c))]) for c, t in (("a", np.uint64), ("b", dtype)))
        order = np.argsort(at)
        return at[order], values[order]

    keys, counts = level("counts", np.int64)
    top = weigh_up(keys, counts, SPLIT - 1, 0, [level(f"weighted{j}", np.float64) for j in range(8)]) if len(keys) else []
    del above
    tidy()
    return table_.where("kind = 'grams'").select("bucket", "a", "b"), {x["depth"]: [n[:3] for n in x["nodes"]] for x in top}


def code_lengths(asked: DataFrame, grams: DataFrame, top: dict, depth: int) -> DataFrame:
    """batch_id, bucket, values: bits of each n-gram asked for, as sent."""
    upper = Model(depth)
    for d in range(SPLIT):
        upper.add(d, top.get(d, []))
    shared = asked.sparkSession.sparkContext.broadcast(upper)

    def answer(asks: pa.Table, rows: pa.Table) -> pa.Table:
        keys, counts = unpacked(rows.column("a"), rows.column("b")) if rows.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        model = shared.value.copy()
        levels = weigh_up(keys, counts, depth, SPLIT)
        while levels:
            level = levels.pop()
            model.add(level["depth"], [n[:3] for n in level["nodes"]])
        del level
        code = model.bits(keys)
        values, unseen = [], []
        for x in asks.column("keys"):
            wanted = np.cumsum(expanded(x.as_buffer()))
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            seen = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
            values.append(np.where(seen, code[at] if len(keys) else 0, np.float32(np.nan)).astype(np.float32))
            unseen.append(wanted[~seen])
        others = np.unique(np.concatenate([np.zeros(0, np.uint64), *unseen]))
        code = model.bits(others)
        for v, x in zip(values, unseen):
            v[np.isnan(v)] = code[np.searchsorted(others, x)]
        return pa.table({"batch_id": asks.column("batch_id"), "bucket": asks.column("bucket"), "values": pa.array([squeezed(v) for v in values], pa.binary())})

    def answered(asks: pa.Table, rows: pa.Table) -> pa.Table:
        try:
            return answer(asks, rows) if asks.num_rows else pa.table({"batch_id": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "values": pa.array([], pa.binary())})
        finally:
            tidy()

    return asked.groupBy("bucket").cogroup(grams.groupBy("bucket")).applyInArrow(answered, "batch_id long, bucket long, values binary")


def word_index(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each distinct word, index of each word into them, and each text's first word."""
    words, at = words_of(texts)
    coded = words.dictionary_encode()
    return hash_bytes(coded.dictionary), coded.indices.to_numpy(), at


def word_counts(stored: DataFrame, buckets: int) -> DataFrame:
    """batch_id, bucket, totals: corpus counts of each batch's distinct words as sent; rows of batch -1: n tokens and v distinct of a bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for batch_id, text, ends, out in zip(*(batch.column(i) for i in range(4))):
                hashes, index, at = word_index(strings_of(text.as_buffer(), ends.values.to_numpy()))
                train = np.repeat(~out.values.to_numpy(zero_copy_only=False), np.diff(at))
                counts = np.bincount(index[train], minlength=len(hashes)).astype(np.uint32)
                order, edges = dealt(hashes, buckets)
                for b in np.flatnonzero(np.diff(edges)):
                    own = order[edges[b] : edges[b + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([batch_id.as_py()], pa.int64()), pa.array([hashes[own].tobytes()]), pa.array([counts[own].tobytes()])], names=["bucket", "batch_id", "hashes", "counts"])

    def answer(rows: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("hashes")]
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column("counts")]).astype(np.int64)
        known, total = add_up(np.concatenate(hashes), counts)
        back = [squeezed(total[np.searchsorted(known, h)].astype(np.int64)) for h in hashes]
        n = len(back)
        return pa.table({"batch_id": [-1, *rows.column("batch_id").to_pylist()], "bucket": rows.column("bucket").to_pylist()[:1] * (n + 1), "totals": [b"", *back], "n": [int(total.sum())] + [0] * n, "v": [int((total > 0).sum())] + [0] * n}, schema=pa.schema([("batch_id", pa.int64()), ("bucket", pa.int64()), ("totals", pa.binary()), ("n", pa.int64()), ("v", pa.int64())]))

    sent = stored.select("batch_id", "text", "ends", "held_out").mapInArrow(tidied(send), "bucket long, batch_id long, hashes binary, counts binary")
    return written(sent.groupBy("bucket").applyInArrow(tidied_group(answer), "batch_id long, bucket long, totals binary, n long, v long"), "ctw-words")


def dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of words or contexts by bucket, and where each bucket begins in it."""
    bucket = (mix(hashes) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Scores of documents (doc_id, held_out, text) under a model of those that aren't held out."""
    if not SPLIT <= depth <= 6:
        raise ValueError(f"depth must be {SPLIT} to 6 bytes")
    stored = batched(docs)
    size = stored.agg(F.sum("n_bytes"), F.sum("train_docs")).first()
    buckets = max(shuffle_partitions(docs.sparkSession), -(-(size[0] or 0) // BUCKET_BYTES))
    counts = word_counts(stored, buckets)
    sums = counts.where("batch_id = -1").agg(F.sum("n"), F.sum("v")).first()
    ends = size[1] or 0
    n, v = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)
    below = np.log10(n + 0.5 * (v + 1))
    end_cost = float(np.log10(ends + 0.5) - below)
    grams, top = fit(stored, depth, buckets)
    lengths = code_lengths(asked_rows(stored, depth, buckets), grams, top, depth)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])

    def filled(out: np.ndarray, order: np.ndarray, edges: np.ndarray, answers: dict[int, pa.Buffer]) -> np.ndarray:
        """What the buckets answered, in the order of the questions."""
        for b in np.flatnonzero(np.diff(edges)).tolist():
            out[order[edges[b] : edges[b + 1]]] = expanded(answers[b], out.dtype)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, out, text, to, answers in zip(*(batch.column(i) for i in range(5))):
                to = to.values.to_numpy()
                texts = strings_of(text.as_buffer(), to)
                given: tuple[dict, dict] = ({}, {})
                if answers.values is not None:
                    kind, bucket, values = (answers.values.field(k) for k in range(3))
                    for k, b, x in zip(kind.to_pylist(), bucket.to_pylist(), values):
                        given[k][b] = x.as_buffer()
                hashes, index, at = word_index(texts)
                total = filled(np.zeros(len(hashes), np.int64), *dealt(hashes, buckets), given[0])
                each = np.log10(total + 0.5) - below
                doc = np.repeat(np.arange(len(to)), np.diff(at))
                base = np.bincount(doc, each[index], len(to)) + end_cost
                known = np.bincount(doc, (total > 0)[index], len(to)).astype(np.int64) + (ends > 0)
                buffer, starts, sizes = pad_texts(rendered(texts), depth)
                coded = pa.array(ngram_keys(buffer, depth)).dictionary_encode()
                grams = coded.dictionary.to_numpy()
                ascending = np.argsort(grams)
                order, edges = dealt(grams[ascending] >> np.uint64(8 * (depth + 1 - SPLIT)), buckets)
                bits = filled(np.zeros(len(grams), np.float32), ascending[order], edges, given[1])
                scores = -text_sums(bits[coded.indices.to_numpy()], starts, sizes, depth) * np.log10(2)
                columns = (doc_ids.values, out.values, pa.array(np.diff(at) + 1), pa.array(known), pa.array(np.full(len(to), n)), pa.array(base), pa.array(scores), pa.array(np.diff(to, prepend=0)))
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)

    answers = counts.where("batch_id >= 0").select("batch_id", F.lit(0).alias("kind"), "bucket", F.col("totals").alias("values"))
    answers = answers.unionByName(lengths.select("batch_id", F.lit(1).alias("kind"), "bucket", "values"))
    answers = answers.groupBy("batch_id").agg(F.collect_list(F.struct("kind", "bucket", "values")).alias("answers"))
    joined = stored.select("batch_id", "doc_ids", "held_out", "text", "ends").join(answers, "batch_id", "left")
    return joined.select("doc_ids", "held_out", "text", "ends", "answers").mapInArrow(tidied(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")


def op7_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", (crc_mod(docs["doc_id"], 5) == 1).alias("held_out"), "text"))
