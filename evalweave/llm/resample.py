"""Importance resampling to a target distribution (operator 13).

Features are runs of one to three words in a fixed number of hashed buckets.
All documents give the bucket counts of the source, all benchmark texts those of
the target; a bucket's gain is the scaled logarithm of their smoothed ratio.  The
gains are one small array, and a document's weight is the sum of its features'
gains.  A draw without replacement by weight adds hashed Gumbel noise and takes
the largest scores.

Words of a text are hashed once each; the hash of a run comes from those of its
words, as CRC-32 is linear: the hash of two parts is that of the first, moved by the
length of the second, and that of the second together.  Texts over a slice's size are
cut between words, and two words are handed on, so a text's features are complete.

The draw sorts and merges.  Each task sorts the keys (score, id, row number) of its
eligible rows into runs of at most ``RUN_ROWS`` and writes them as blocks to the
shared folder.  A bounded number of sampled keys cuts the order into ranges, whose
exact numbers of rows are counted; so the range in which the draw ends is known, and
no later block is read again.  Each range is merged by one task: a tournament tree
over the runs' pieces hands out the largest key, and stops at the exact count.  The
rank is the number of rows in earlier ranges and the place within the range.  Keys
are unique by row number, so no group of equal scores or ids is too large to cut.

Null and empty texts have no words: no features, weight 0, not eligible.  A null
id counts as the empty text in the hash, and goes last of equal scores.  Rows of one
id and text have equal scores; each is its own candidate and has its own rank.
Extra columns play no part, whatever their names.  Without benchmark texts the target
is empty, its smoothed counts still give gains.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, raw_of, shuffle_partitions, slices, table, texts_of, tidied, tidied_group, words_of, written

BUCKETS = 10_000
LONGEST = 3
SEED = 42
SCALE = 1000
LEAST_WORDS = 20
DRAWN_PERCENT = 5
#: Rows of a sorted run, and of a block of one.
RUN_ROWS, BLOCK_ROWS = 1 << 20, 4096
#: Rows of a range that are aimed at, and most ranges.
RANGE_ROWS, MOST_RANGES = 8192, 1 << 16


# --- hashes of word runs


def _shift_tables(longest: int) -> np.ndarray:
    """[length, byte of the hash, its value]: what a hash becomes when so many bytes follow."""
    single = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    plain = single ^ single[0]  # the table of the polynomial, without the inverting of start and end
    # one zero byte moves a hash by (hash >> 8) ^ table[hash & 255]
    value = np.arange(256, dtype=np.uint32)
    now = np.stack([value << np.uint32(8 * k) for k in range(4)])
    out = [now]
    for _ in range(longest):
        now = (now >> np.uint32(8)) ^ plain[now & np.uint32(255)]
        out.append(now)
    return np.stack(out)


#: Longer words are moved in steps of this many bytes.
STEP_BYTES = 64
SHIFTS = _shift_tables(STEP_BYTES)
SPACE = np.uint32(zlib.crc32(b" "))


def moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The part of a hash of two texts that is due to the first: its hash, moved by the second's length."""
    out, by = crc.copy(), by.copy()
    while len(by) and by.max() > STEP_BYTES:
        long = np.flatnonzero(by > STEP_BYTES)
        out[long] = _moved(out[long], np.full(len(long), STEP_BYTES))
        by[long] -= STEP_BYTES
    return _moved(out, by)


def _moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    out = SHIFTS[by, 0, crc & np.uint32(255)]
    for k in range(1, 4):
        out ^= SHIFTS[by, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes, cut where a separator is."""
    first = 0
    while first < len(text):
        last = first + size
        while last < len(text) and not SEPARATORS[text[last]]:
            last += 1
        yield text[first:last]
        first = last


#: Hashes and lengths of words: (uint32 array, long array).
Words = tuple[np.ndarray, np.ndarray]
NO_WORDS: Words = (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def hashed_words(texts: pa.StringArray) -> tuple[Words, np.ndarray]:
    """Hash and length of each word of the texts, and the index of each text's first word (one more at the end)."""
    words, at = words_of(texts, SEPARATORS)
    coded = words.dictionary_encode()
    known = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy()
    crc = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))
    length = np.fromiter(map(len, known), np.int64, len(known))
    return (crc[codes], length[codes]), at


def run_hashes(words: Words, starts: np.ndarray, skip: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words: the index of each run's last word and the run's hash.

    ``starts`` is, for each word, the index of its text's first word; runs that end before ``skip`` are left out.
    """
    crc, length = words
    ends = np.arange(skip, len(crc))
    out, now = [(ends, crc[skip:])], crc
    for n in range(2, LONGEST + 1):
        # ``now`` holds the hashes of runs of n - 1 words by their last word; one more word follows
        following = np.zeros_like(crc)
        following[1:] = moved(moved(now[:-1], np.ones(len(now) - 1, np.int64)) ^ SPACE, length[1:]) ^ crc[1:] if len(crc) > 1 else 0
        now = following
        inside = ends[ends - (n - 1) >= starts[ends]]
        out.append((inside, now[inside]))
    return out


def buckets_of(texts: pa.StringArray, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, text, bucket, number of words) for rows of some texts: text (from first) and bucket of each feature.

    A text over ``size`` bytes comes alone and in several parts.
    """
    _, offsets = raw_of(texts)
    for first, last in slices(texts, size):
        if last == first + 1 and offsets[last] - offsets[first] > size:
            held = NO_WORDS
            for part in pieces(texts[first].as_py().encode(), size):
                new, _ = hashed_words(pa.array([part]).cast(pa.string()))
                words = tuple(np.concatenate(x) for x in zip(held, new))
                runs = run_hashes(words, np.zeros(len(words[0]), np.int64), len(held[0]))
                yield first, last, np.zeros(sum(len(e) for e, _ in runs), np.int64), np.concatenate([h for _, h in runs]) % BUCKETS, np.array([len(new[0])])
                held = tuple(x[max(len(x) - LONGEST + 1, 0) :] for x in words)
            continue
        words, at = hashed_words(texts.slice(first, last - first))
        n = np.diff(at)
        of = np.repeat(np.arange(last - first), n)
        runs = run_hashes(words, np.repeat(at[:-1], n))
        yield first, last, np.concatenate([of[e] for e, _ in runs]), np.concatenate([h for _, h in runs]) % BUCKETS, n


SLICE = 2 << 20


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts (column text) by bucket; each task sends one row for each bucket that it has met."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, _, bucket, _ in buckets_of(texts_of(batch.column(0)), SLICE):
                total += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], schema=schema)

    counted = texts.select(texts["text"].cast("string").alias("text")).mapInArrow(tidied(run), "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    # as many rows as there are buckets
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(SCALE * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """row (unique in the result), doc_id, n_words, n_features, weight and score of each document."""
    given = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    given = given.withColumn("h", draw)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weight = np.zeros((3, batch.num_rows), np.int64)
            for first, last, text, bucket, n in buckets_of(texts_of(batch.column(1)), SLICE):
                words[first:last] += n
                features[first:last] += np.bincount(text, minlength=last - first)
                # sums of whole numbers, exact in doubles below 2^53
                weight[first:last] += np.bincount(text, gain[bucket], last - first).astype(np.int64)
            noise = [math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296))) for h in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), *map(pa.array, (words, features, weight, weight + np.array(noise, np.int64)))], schema=schema)

    return given.mapInArrow(tidied(run), "row long, doc_id long, n_words long, n_features long, weight long, score long")


# --- the draw

#: A key's parts in the order of ranks, all ascending: minus score, id (null: the largest), row number.
KEYS = ("minus", "id", "row")
NULL_ID = (1 << 63) - 1
RUN_SCHEMA = "run long, block int, minus array<long>, id array<long>, row array<long>, first_minus long"
ARROW_RUN = pa.schema([("run", pa.int64()), ("block", pa.int32()), *((k, pa.list_(pa.int64())) for k in KEYS), ("first_minus", pa.int64())])


def sorted_runs(eligible: DataFrame) -> DataFrame:
    """Blocks of the sorted runs of each task's rows (minus, id, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def one() -> Iterator[pa.RecordBatch]:
            keys = [np.concatenate([h[k] for h in held]) for k in range(3)]
            order = np.lexsort(keys[::-1])
            keys = [k[order] for k in keys]
            number = int(keys[2].min())  # row numbers are unique, and so is the smallest of a run
            for block, at in enumerate(range(0, len(order), BLOCK_ROWS)):
                part = [k[at : at + BLOCK_ROWS] for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([block], pa.int32()), *(pa.array([p.tolist()], pa.list_(pa.int64())) for p in part), pa.array([int(part[0][0])])], schema=ARROW_RUN)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= RUN_ROWS:
                yield from one()
                held, n = [], 0
        if held:
            yield from one()

    return eligible.select(*KEYS).mapInArrow(tidied(run), RUN_SCHEMA)


def tournament(runs: list[Iterable[tuple]], most: int) -> Iterator[tuple]:
    """The ``most`` smallest items of sorted runs, in order, by a tree of losers.

    Leaves are runs; an inner node keeps the run that lost there, the winner of all is
    handed out and only the matches on its way up are played again.
    """
    heads = [iter(r) for r in runs]
    k = len(heads)
    if not k:
        return
    end = (math.inf,)
    items = [next(h, end) for h in heads]
    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if items[a] <= items[b] else (b, a)
    best = winners[1] if k > 1 else 0
    for _ in range(most):
        if items[best] is end:
            return
        yield items[best]
        items[best] = next(heads[best], end)
        node = (best + k) >> 1
        while node:
            other = losers[node]
            if items[other] < items[best]:
                losers[node], best = best, other
            node >>= 1


def pieces_of(runs: DataFrame, splits: list[tuple], last: int | None, body) -> DataFrame:
    """Blocks cut at the splits: rows of ``body(range, run, block, keys)`` for ranges up to ``last``."""
    bounds = np.array(splits, np.int64).reshape(-1, 3)
    kind, make = body

    def place(keys: list[np.ndarray]) -> np.ndarray:
        """How many rows of a sorted block lie before each split."""
        low, high = (np.searchsorted(keys[0], bounds[:, 0], side=s) for s in ("left", "right"))
        for i in np.flatnonzero(high > low):
            a, b = low[i], high[i]
            c, d = a + np.searchsorted(keys[1][a:b], bounds[i, 1], "left"), a + np.searchsorted(keys[1][a:b], bounds[i, 1], "right")
            low[i] = c + np.searchsorted(keys[2][c:d], bounds[i, 2], "left")
        return low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = [batch.column(2 + k)[i].values.to_numpy() for k in range(3)]
                cut = np.concatenate(([0], place(keys), [len(keys[0])]))
                for r in np.flatnonzero(np.diff(cut)):
                    if last is None or r <= last:
                        yield make(int(r), batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), [k[cut[r] : cut[r + 1]] for k in keys])

    return runs.mapInArrow(tidied(run), kind)


def ranks(eligible: DataFrame, most: int) -> DataFrame:
    """row and rank (from 1) of the ``most`` first rows of ``eligible`` (minus, id, row)."""
    spark = eligible.sparkSession
    if most < 1:
        return spark.createDataFrame([], "row long, rank long")
    runs = written(sorted_runs(eligible), "runs")
    n = runs.select(F.sum(F.size("row")).alias("n")).first()["n"] or 0
    # one in ``step`` keys, by their hashes: at most about MOST_RANGES come to the driver
    step = max(RANGE_ROWS, n // MOST_RANGES)
    zipped = runs.select(F.explode(F.arrays_zip(*KEYS)).alias("k")).select("k.*") if n > step else None
    splits = sorted(tuple(r) for r in zipped.where(F.pmod(F.xxhash64("row"), F.lit(step)) == 0).collect()) if zipped is not None else []
    counted_schema = pa.schema([("range", pa.int32()), ("n", pa.int64())])
    counts = pieces_of(runs, splits, None, ("range int, n long", lambda r, run, block, keys: pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([len(keys[0])])], schema=counted_schema)))
    sizes = np.zeros(len(splits) + 1, np.int64)
    for r in counts.groupBy("range").agg(F.sum("n").alias("n")).collect():
        sizes[r["range"]] = r["n"]
    before = np.cumsum(sizes) - sizes
    last = min(int(np.searchsorted(np.cumsum(sizes), most)), len(sizes) - 1)
    if last < len(splits):  # blocks that begin after the last range's end hold nothing to draw
        runs = runs.where(F.col("first_minus") <= splits[last][0])
    piece_schema = pa.schema([("range", pa.int32()), *ARROW_RUN.remove(5)])
    make = lambda r, run, block, keys: pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([run]), pa.array([block], pa.int32()), *(pa.array([k.tolist()], pa.list_(pa.int64())) for k in keys)], schema=piece_schema)
    cut = pieces_of(runs, splits, last, ("range int, " + RUN_SCHEMA.rsplit(",", 1)[0], make))
    out_schema = pa.schema([("row", pa.int64()), ("rank", pa.int64())])

    def merge(group: pa.Table) -> pa.Table:
        r = group["range"][0].as_py()
        of_run: dict[int, list[int]] = {}
        blocks, numbers = group["block"].to_pylist(), group["run"].to_pylist()
        for i in sorted(range(group.num_rows), key=lambda i: (numbers[i], blocks[i])):
            of_run.setdefault(numbers[i], []).append(i)

        def rows(at: list[int]) -> Iterator[tuple]:
            for i in at:
                yield from zip(*(group[k][i].values.to_numpy().tolist() for k in KEYS))

        drawn = [item[2] for item in tournament([rows(at) for at in of_run.values()], min(int(sizes[r]), most - int(before[r])))]
        return pa.table([pa.array(drawn, pa.int64()), pa.array(np.arange(len(drawn)) + int(before[r]) + 1)], schema=out_schema)

    return cut.repartition(max(shuffle_partitions(spark), 1), "range").groupBy("range").applyInArrow(tidied_group(merge), "row long, rank long")


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of each row of ``docs`` (doc_id, text), by the texts of ``target`` (text)."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    # row numbers hold once they are written
    rows = written(scored(docs, gain, seed), "scored")
    eligible = rows.where(F.col("n_words") >= least_words)
    n = eligible.count()
    drawn = ranks(eligible.select((-F.col("score")).alias("minus"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "row"), percent * n // 100)
    return rows.join(drawn, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
