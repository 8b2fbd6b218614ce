"""Near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures (operator 8).

A signature has ``chunks`` chunks of ``chunk_size`` minima, ``BITS`` bits each.
Two signatures that differ in at most 2 * chunks - 1 places have a chunk with at
most one error (pigeonhole), so they share one of the keys made of a chunk with
one place left out: all pairs under that signature distance are found.

1. Documents of equal shingle sets (two digests and the size) are one class with
   a number of its own.
2. Keys meet in buckets of bounded size.  A key of up to ``SMALL`` classes gives
   all pairs, a larger one a star around its smallest class.  A task that holds
   many classes of one key gives its part of the star at once and sends only the
   star's centre on, so a key that all documents have doesn't gather in one task.
   Pairs whose whole signatures are too far apart go; the rest join classes into
   families.
3. Large keys whose classes are in several families: each other family is
   compared with all of the key's largest one, and the others with each other,
   on signatures, block by block, so no pair of a key is left out.
4. Links are confirmed on full shingle sets.  First each set travels once: to a
   block of its family, which has the family's first class too.  Only families
   that this leaves in several pieces compare the pieces, block by block.
5. Links give components.

No cap is set on keys, families or partners.

Null and empty texts and texts without words have the empty set and are linked
with nothing.  Rows with a null id take part in no link: component_id null, kept
true.  Repeated rows stay and have the same component; rows of one id with
different texts are documents of their own, which bear the same id.  Texts of any
length count whole.  An empty table gives no rows.  Other columns of ``docs`` play
no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_bytes, mix, ranges, shuffle_partitions, slices, table, texts_of, tidied, tidied_group, words_of, written
from .components import components

CHUNKS, CHUNK_SIZE, BITS = 14, 6, 16
#: Keys of up to so many classes give all their pairs at once.
SMALL = 8
#: Bytes of keys in a bucket and of sets in a task, about.
BUCKET_BYTES, TASK_BYTES = 16 << 20, 32 << 20
#: Classes of a slice, in which a key's star is made at once.
SLICE_ROWS = 20_000
#: Mixed keys (16 bytes each) that go to all workers; more are joined.
HELD_KEYS = 1 << 20
#: Signatures or sets that a task holds on either side.
BLOCK, SET_BLOCK = 1024, 256
SEED = 20240229


def shingle_sets(texts: pa.StringArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts, and where each text's begin (one more at the end)."""
    words, at = words_of(texts)
    coded = words.dictionary_encode()
    word = mix(hash_bytes(coded.dictionary) + np.uint64(1))[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    n_words = np.diff(at)
    size = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    edges = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(int(edges[-1]), np.uint64)
    full = n_words >= width
    start = np.repeat(np.where(full, at[:-1], 0) - edges[:-1], np.where(full, size, 0))
    where = np.repeat(full, size)
    first = start + np.flatnonzero(where)
    value = np.full(len(first), width, np.uint64)
    for k in range(width):
        value = mix(value + word[first + k] * np.uint64(2 * k + 3))
    out[where] = value
    for i in np.flatnonzero(~full & (n_words > 0)):
        value = np.full(1, n_words[i], np.uint64)
        for k in range(n_words[i]):
            value = mix(value + word[at[i] + k : at[i] + k + 1] * np.uint64(2 * k + 3))
        out[edges[i]] = value[0]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    inner = edges[:-1][size > 0]
    keep[inner] = True
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[edges]


class Signer:
    """Minima of ``chunks * chunk_size`` hash functions, cut to ``BITS`` bits."""

    def __init__(self, chunks: int, chunk_size: int):
        rng = np.random.default_rng(SEED)
        self.chunks, self.chunk_size = chunks, chunk_size
        self.a = rng.integers(0, 1 << 63, chunks * chunk_size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, chunks * chunk_size, dtype=np.uint64)

    def sign(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row of 16-bit values for each set; empty sets get zeros."""
        out = np.zeros((len(at) - 1, len(self.a)), np.uint16)
        some = np.flatnonzero(np.diff(at))
        if len(some):
            starts, room = at[some], np.empty_like(flat)
            for k, (a, b) in enumerate(zip(self.a, self.b)):
                np.multiply(flat, a, out=room)
                np.add(room, b, out=room)
                out[some, k] = mix(np.minimum.reduceat(room, starts)).astype(np.uint16)
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """A row of keys for each signature: each chunk with each of its places left out."""
        place = np.arange(signatures.shape[1], dtype=np.uint64) << np.uint64(BITS)
        each = mix(signatures.astype(np.uint64) + place + np.uint64(1)).reshape(len(signatures), self.chunks, self.chunk_size)
        rest = each.sum(axis=2, dtype=np.uint64)[:, :, None] - each
        return mix(rest + np.arange(self.chunks * self.chunk_size, dtype=np.uint64).reshape(self.chunks, self.chunk_size)).reshape(len(signatures), -1)


def signed(docs: DataFrame, width: int, signer: Signer) -> DataFrame:
    """doc_id, text_key, n_shingles, the set's two digests (vertex, second) and its signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("n_shingles", pa.int64()), ("vertex", pa.int64()), ("second", pa.int64()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for first, last in slices(texts):
                flat, at = shingle_sets(texts.slice(first, last - first), width)
                one, two = set_digests(flat, at)
                rows = signer.sign(flat, at)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, last - first).cast(kind) for k, kind in ((0, pa.int64()), (2, pa.string()))), pa.array(np.diff(at)), pa.array(one), pa.array(two), pa.array([r.tobytes() for r in rows], pa.binary())], schema=schema)

    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long"), text, F.md5(text.cast("binary"))).mapInArrow(tidied(run), "doc_id long, text_key string, n_shingles long, vertex long, second long, signature binary")


def set_digests(flat: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    total = lambda x: np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
    return [np.diff(total(mix(flat ^ np.uint64(salt)))[at]).view(np.int64) for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def ordered_keys(signatures: bytes, rows: int, signer: Signer) -> tuple[np.ndarray, np.ndarray]:
    """Keys of some signatures and the row that each is of, ordered by key and row."""
    keys = signer.keys(np.frombuffer(signatures, np.uint16).reshape(rows, -1))
    order = np.argsort(keys.ravel(), kind="stable")
    return keys.ravel()[order], order // keys.shape[1]


def keys_of(batch: pa.RecordBatch, column: int, signer: Signer) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their keys and the row that each key is of."""
    for first in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(first, SLICE_ROWS)
        yield part, *ordered_keys(b"".join(part.column(column).to_pylist()), part.num_rows, signer)


def sliced(classes: DataFrame) -> DataFrame:
    """ids, signatures: stored slices of classes, which later passes read as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()]), pa.array([b"".join(part.column(1).to_pylist())])], names=["ids", "signatures"])

    return classes.select("id", "signature").mapInArrow(tidied(run), "ids binary, signatures binary")


def of_slices(batches: Iterator[pa.RecordBatch], signer: Signer) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of each slice and their owners."""
    for batch in batches:
        for ids, signatures in zip(*batch.columns):
            ids = np.frombuffer(ids.as_buffer(), np.int64)
            keys, row = ordered_keys(signatures.as_buffer(), len(ids), signer)
            yield keys, ids[row]


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets and the places of their keys."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first = starts_of(bucket[order])
    for a, b in zip(first, np.append(first[1:], len(order))):
        yield int(bucket[order[a]]), order[a:b]


def key_rows(slices: DataFrame, signer: Signer, buckets: int) -> DataFrame:
    """bucket, keys, owners: of a key that more than SMALL classes of a slice have, only the first class, as -1 - number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, owner in of_slices(batches, signer):
            first = starts_of(keys)
            size = np.diff(np.append(first, len(keys)))
            hidden = np.repeat(size > SMALL, size)
            lead = first[size > SMALL]
            owner[lead] = -1 - owner[lead]
            hidden[lead] = False
            keys, owner = keys[~hidden], owner[~hidden]
            for b, own in dealt(keys, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([keys[own].tobytes()]), pa.array([owner[own].tobytes()])], names=["bucket", "keys", "owners"])

    return slices.mapInArrow(tidied(run), "bucket long, keys binary, owners binary")


def pairs_and_large(pairs: np.ndarray, large: np.ndarray) -> pa.Table:
    """Rows (u, v) of pairs, and (u, null) of classes that have a large key; each once."""
    pairs, large = np.unique(pairs, axis=0), np.unique(large)
    return pa.table({"u": pa.chunked_array([pa.array(pairs[:, 0]), pa.array(large)]), "v": pa.chunked_array([pa.array(pairs[:, 1]), pa.nulls(len(large), pa.int64())])})


def stars(first: np.ndarray, size: np.ndarray, owners: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the first owner of each large key with its others, and all owners of large keys."""
    member = np.flatnonzero(np.repeat(large, size))
    lead = np.repeat(first[large], size[large])
    rest = member != lead
    return np.stack([owners[lead[rest]], owners[member[rest]]], 1), owners[member]


def local_stars(slices: DataFrame, signer: Signer) -> DataFrame:
    """The stars of keys that more than SMALL classes of a slice have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, owner in of_slices(batches, signer):
            first = starts_of(keys)
            size = np.diff(np.append(first, len(keys)))
            yield from pairs_and_large(*stars(first, size, owner, size > SMALL)).combine_chunks().to_batches()

    return slices.mapInArrow(tidied(run), "u long, v long")


def meetings(rows: pa.Table) -> pa.Table:
    """All pairs of a bucket's small keys, the stars of its large ones, and the owners of large ones."""
    keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("keys")])
    owners = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("owners")])
    centre = owners < 0
    owners = np.where(centre, -1 - owners, owners)
    order = np.lexsort((owners, keys))
    keys, owners, centre = keys[order], owners[order], centre[order]
    first = starts_of(keys)
    size = np.diff(np.append(first, len(keys)))
    large = (size > SMALL) | np.logical_or.reduceat(centre, first)
    found, members = stars(first, size, owners, large)
    pairs = [found]
    for n in range(2, SMALL + 1):
        at = first[(size == n) & ~large]
        for i in range(n):
            for j in range(i + 1, n):
                pairs.append(np.stack([owners[at + i], owners[at + j]], 1))
    return pairs_and_large(np.concatenate(pairs), members)


def close_pairs(pairs: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """Pairs whose signatures differ in at most ``most`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
                near = np.concatenate([(a[i : i + 50_000] != b[i : i + 50_000]).sum(1) <= most for i in range(0, len(a), 50_000)])
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in (0, 1)], names=["u", "v"])

    # merge joins at every size: all of these sides grow with the corpus
    sides = [classes.select(F.col("id").alias(x), F.col("signature").alias(f"{x}_signature")).hint("merge") for x in "uv"]
    return pairs.join(sides[1], "v").join(sides[0], "u").select("u", "v", "u_signature", "v_signature").mapInArrow(tidied(run), "u long, v long")


def mixed_keys(labelled: DataFrame, signer: Signer, buckets: int) -> DataFrame:
    """key, main, other: of each large key whose classes are in several families, the family of most of them and each other one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, keys, row in keys_of(batch, 2, signer):
                label = part.column(1).to_numpy()[row]
                order = np.lexsort((label, keys))
                keys, label = keys[order], label[order]
                first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (label[1:] != label[:-1]))))
                count = np.diff(np.append(first, len(keys)))
                keys, label = keys[first], label[first]
                for b, own in dealt(keys, buckets):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), *(pa.array([x[own].tobytes()]) for x in (keys, label, count))], names=["bucket", "keys", "labels", "counts"])

    def several(rows: pa.Table) -> pa.Table:
        keys, label, count = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in rows.column(c)]) for c, kind in (("keys", np.uint64), ("labels", np.int64), ("counts", np.int64)))
        order = np.lexsort((label, keys))
        keys, label, count = keys[order], label[order], count[order]
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (label[1:] != label[:-1]))))
        keys, label, count = keys[first], label[first], np.add.reduceat(count, first)
        # the family of most classes first, then the others
        order = np.lexsort((label, -count, keys))
        keys, label, count = keys[order], label[order], count[order]
        first = starts_of(keys)
        size = np.diff(np.append(first, len(keys)))
        wanted = (size > 1) & (np.add.reduceat(count, first) > SMALL)
        main = np.repeat(label[first], size)
        other = np.repeat(wanted, size)
        other[first] = False
        return pa.table({"key": keys[other].view(np.int64), "main": main[other], "other": label[other]})

    sent = labelled.select("id", "label", "signature").mapInArrow(tidied(run), "bucket long, keys binary, labels binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(tidied_group(several), "key long, main long, other long")


def members_of(keys: DataFrame, labelled: DataFrame, signer: Signer) -> DataFrame:
    """key, id, label, signature of the classes that have one of some keys (key, main) and aren't of the main family."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("signature", pa.binary())])
    known = None
    if keys.count() <= HELD_KEYS:
        rows = keys.toArrow()  # HELD_KEYS rows at most
        order = np.argsort(rows.column("key").to_numpy().view(np.uint64))
        known = keys.sparkSession.sparkContext.broadcast((rows.column("key").to_numpy().view(np.uint64)[order], rows.column("main").to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, key, row in keys_of(batch, 2, signer):
                if known is not None:
                    wanted, main = known.value
                    at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                    there = (wanted[at] == key) & (main[at] != part.column(1).to_numpy()[row])
                    key, row = key[there], row[there]
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *taken.columns], schema=schema)

    out = labelled.select("id", "label", "signature").mapInArrow(tidied(run), "key long, id long, label long, signature binary")
    return out if known is not None else out.join(keys, "key").where("label <> main").drop("main")


def spread(rows: DataFrame, block: int, among: bool) -> DataFrame:
    """Rows (grp, main, id, ...) with i, j, own: every main row meets every other row of its group in one pair of blocks, and with ``among`` the others meet each other."""
    sizes = rows.groupBy("grp").agg(*(F.ceil(F.count_if(x) / block).cast("int").alias(c) for c, x in (("mains", F.col("main")), ("others", ~F.col("main")))))
    out = rows.join(sizes.where("mains + others > 0"), "grp")
    of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    last = F.col("mains") + F.col("others") - 1 if among else F.col("mains") - 1
    number = lambda a, b: F.when(b >= a, F.sequence(a, b))
    out = out.withColumn("own", F.when(F.col("main"), of("mains")).otherwise(F.col("mains") + of("others")))
    out = out.withColumn("other", F.explode(F.when(F.col("main"), number(F.col("mains"), F.col("mains") + F.col("others") - 1)).otherwise(number(F.lit(0), last))))
    return out.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("main", "mains", "others", "other")


def cross_pairs(large: DataFrame, classes: DataFrame, labels: DataFrame, signer: Signer, buckets: int, most: int) -> DataFrame | None:
    """Edges between families that share a large key: close signatures across families, block by block."""
    labelled = large.select(F.col("u").alias("id")).distinct().join(labels.select(F.col("u").alias("id"), "label").hint("merge"), "id", "left").join(classes.hint("merge"), "id")
    labelled = written(labelled.select("id", F.coalesce("label", "id").alias("label"), "signature"), "large-keys")
    mixed = written(mixed_keys(labelled, signer, buckets), "mixed-keys")
    if mixed.isEmpty():
        return None
    met = mixed.select("main", "other").distinct()
    mains = labelled.join(met.select(F.col("main").alias("label")).distinct(), "label").select(F.col("label").alias("grp"), F.lit(True).alias("main"), "id", "label", "signature")
    others = labelled.join(met.withColumnRenamed("other", "label"), "label").select(F.col("main").alias("grp"), F.lit(False).alias("main"), "id", "label", "signature")
    rows = spread(mains.unionByName(others), BLOCK, False).withColumn("kind", F.lit(0))
    several = written(mixed.groupBy("key").agg(F.first("main").alias("main"), F.count("*").alias("n")).where("n > 1").select("key", "main"), "several")
    if not several.isEmpty():
        rest = members_of(several, labelled, signer).select(F.col("key").alias("grp"), F.lit(False).alias("main"), "id", "label", "signature")
        rows = rows.unionByName(spread(rest, BLOCK, True).withColumn("kind", F.lit(1)))

    def compare(part: pa.Table) -> pa.Table:
        label, own = (part.column(c).to_numpy() for c in ("label", "own"))
        i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(len(label), -1)
        found: dict[tuple[int, int], None] = {}
        right = np.flatnonzero(own == j)
        for a in np.flatnonzero(own == i):
            b = right[label[right] != label[a]]
            for other in np.unique(label[b[(sig[b] != sig[a]).sum(1) <= most]]):
                found[min(label[a], other), max(label[a], other)] = None
        return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([y for _, y in found], pa.int64())})

    return rows.groupBy("kind", "grp", "i", "j").applyInArrow(tidied_group(compare), "u long, v long").distinct()


def confirm(rows: pa.Table, percent: int) -> pa.Table:
    """Links that connect pieces of the same family and pair of blocks; each is confirmed on the full sets."""
    number, family, i, j, own, piece = (rows.column(c).to_numpy() for c in ("id", "family", "i", "j", "own", "piece"))
    sets = rows.column("shingles")
    order = np.lexsort((number, j, i, family))
    change = np.ones(len(order), bool)
    change[1:] = (family[order][1:] != family[order][:-1]) | (i[order][1:] != i[order][:-1]) | (j[order][1:] != j[order][:-1])
    bounds = np.append(np.flatnonzero(change), len(order))
    links: list[tuple[int, int]] = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        own_rows = order[a:b]
        same = i[own_rows[0]] == j[own_rows[0]]
        left = np.ones(b - a, bool) if same else own[own_rows] == i[own_rows[0]]
        links += block_links([np.frombuffer(sets[int(r)].as_buffer(), np.uint64) for r in own_rows], number[own_rows], piece[own_rows], left, same, percent)
    return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})


def block_links(sets: list[np.ndarray], number: np.ndarray, piece: np.ndarray, left: np.ndarray, same: bool, percent: int) -> list[tuple[int, int]]:
    """Links between rows of different pieces; rows that have been linked aren't compared again."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    root = np.unique(piece, return_inverse=True)[1]
    index = None
    links = []

    def join(a: int, b: int) -> None:
        links.append((int(number[a]), int(number[b])))
        old, new = root[a], root[b]
        root[root == old] = new

    for a in range(n) if same else np.flatnonzero(left):
        other = np.arange(a) if same else np.flatnonzero(~left)
        while True:
            b = other[(root[other] != root[a])]
            b = b[(100 * np.minimum(size[b], size[a]) >= percent * np.maximum(size[b], size[a]))]
            if not len(b):
                break
            lead = b[0]
            common = len(np.intersect1d(sets[a], sets[lead], assume_unique=True))
            if 100 * common >= percent * (size[a] + size[lead] - common):
                join(a, lead)
                continue
            if len(b) > 1:
                if index is None:
                    flat = np.concatenate(sets)
                    owner = np.repeat(np.arange(n), size)
                    by = np.argsort(flat, kind="stable")
                    index = (flat[by], owner[by])
                lo, hi = (np.searchsorted(index[0], sets[a], side) for side in ("left", "right"))
                common = np.bincount(index[1][ranges(lo, hi - lo)], minlength=n)[b]
                for c in b[100 * common >= percent * (size[a] + size[b] - common)]:
                    if root[c] != root[a]:
                        join(a, c)
            break
    return links


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, chunks: int = CHUNKS, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """doc_id, text_key (MD5 of the text), n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    signer = Signer(chunks, chunk_size)
    places = chunks * chunk_size
    # a pair at the threshold has so many different places on average, and six standard deviations more almost never
    apart = (100 - percent) / 100
    most = min(places - 1, max(2 * chunks - 1, math.ceil(apart * places + 6 * math.sqrt(apart * (1 - apart) * places))))
    rows = written(signed(docs, width, signer), "signed")
    some = rows.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("vertex", "second", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    buckets = max(shuffle_partitions(spark), math.ceil(classes.count() * places * 16 / BUCKET_BYTES))
    parts = written(sliced(classes), "slices")
    met = key_rows(parts, signer, buckets).groupBy("bucket").applyInArrow(tidied_group(meetings), "u long, v long")
    met = written(met.unionByName(local_stars(parts, signer)), "meetings")
    labels = components(close_pairs(met.where("v is not null").distinct(), classes, most))
    across = cross_pairs(met.where("v is null"), classes, labels, signer, buckets, most)
    if across is not None:
        # families that turn out to be connected become one; a class without a family is its own label
        joined = components(across)
        all_labels = labels.unionByName(joined.join(labels.select("u"), "u", "left_anti").select("u", F.col("u").alias("label")))
        labels = all_labels.join(joined.select(F.col("u").alias("label"), F.col("label").alias("end")), "label", "left").select("u", F.coalesce("end", "label").alias("label"))
        labels = written(labels, "families")
    ends = components(confirmed(docs, classes, labels, width, percent))
    placed = classes.join(ends.select(F.col("u").alias("id"), "label").hint("merge"), "id", "left").select("vertex", "second", "n_shingles", "doc_id", F.coalesce("label", "id").alias("label"))
    least = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = placed.join(least.hint("merge"), "label").select("vertex", "second", "n_shingles", "component_id")
    out = rows.drop("signature").join(found.hint("merge"), ["vertex", "second", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") == 0) | F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def shingled(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The rows of ``wanted`` (doc_id, id, family, own, i, j, piece, vertex, second) with their full shingle sets."""
    schema = pa.schema([("id", pa.int64()), ("family", pa.int64()), ("own", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("piece", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts_of(batch.column(3))
            for first, last in slices(column):
                flat, at = shingle_sets(column.slice(first, last - first), width)
                raw = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(flat)])
                # a repeated id may have other texts
                own = batch.slice(first, last - first)
                same = np.logical_and(*(digest == own.column(k).to_numpy() for k, digest in enumerate(set_digests(flat, at))))
                at_rows = np.repeat(np.flatnonzero(same), [len(x) for x, y in zip(own.column(2).to_pylist(), same) if y])
                places = own.column(2).filter(pa.array(same)).flatten()
                part = np.cumsum(np.diff(at)[at_rows] * 8) // TASK_BYTES  # a set that goes to many blocks in batches of bounded size
                for a, b in zip(starts_of(part), np.append(starts_of(part)[1:], len(part))):
                    yield pa.RecordBatch.from_arrays([*(places.field(k).slice(a, b - a) for k in range(6)), raw.take(pa.array(at_rows[a:b]))], schema=schema)

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # one row for each class, so that a text is cut into shingles once
    each = wanted.groupBy("doc_id", "vertex", "second").agg(F.collect_list(F.struct("id", "family", "own", "i", "j", "piece")).alias("places"))
    joined = texts.join(each.hint("merge"), "doc_id").select("vertex", "second", "places", "text")
    return joined.mapInArrow(tidied(run), "id long, family long, own int, i int, j int, piece long, shingles binary")


def linked(sets: DataFrame, shingles: int, percent: int) -> DataFrame:
    """Links (u, v) that the tasks find among the sets of each pair of blocks; ``shingles``: how many there are, about."""
    tasks = max(8 * shuffle_partitions(sets.sparkSession), math.ceil(shingles * 8 / TASK_BYTES))
    dealt_out = sets.withColumn("task", F.pmod(F.xxhash64("family", "i", "j"), F.lit(tasks)))
    return written(dealt_out.groupBy("task").applyInArrow(tidied_group(lambda rows: confirm(rows, percent)), "u long, v long"), "links")


def confirmed(docs: DataFrame, classes: DataFrame, labels: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) between classes of a family."""
    sizes = labels.groupBy("label").agg(F.ceil(F.count("*") / SET_BLOCK).cast("int").alias("blocks"))
    members = classes.drop("signature").join(labels.withColumnRenamed("u", "id").hint("merge"), "id").join(sizes, "label").withColumnRenamed("label", "family")
    members = written(members, "members")
    # a family is named by its first class, which goes to each of its blocks; the others go to one
    own = F.when(F.col("id") == F.col("family"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    once = members.withColumn("own", F.explode(own)).withColumn("i", F.col("own")).withColumn("j", F.col("own")).withColumn("piece", F.col("id"))
    sets = written(shingled(docs, once, width), "family-sets")
    links = linked(sets, members.agg(F.sum("n_shingles")).first()[0] or 0, percent)
    large = members.where("blocks > 1").select("id", "family", "n_shingles")
    if large.isEmpty():
        return links
    pieces = components(links).select(F.col("u").alias("id"), F.col("label").alias("piece"))
    large = large.join(pieces, "id", "left").withColumn("piece", F.coalesce("piece", "id"))
    counts = large.groupBy("family", "piece").agg(F.count("*").alias("n"))
    main = counts.groupBy("family").agg(F.max(F.struct("n", "piece")).alias("top"), F.count("*").alias("pieces")).where("pieces > 1").select("family", F.col("top.piece").alias("top"))
    left = written(large.join(main, "family").withColumn("main", F.col("piece") == F.col("top")).drop("top"), "pieces")
    if left.isEmpty():
        return links
    more = spread(left.withColumnRenamed("family", "grp"), SET_BLOCK, True).withColumnRenamed("grp", "family")
    again = sets.where("id <> family or own = 0").select("id", "shingles").join(left.select("id"), "id", "left_semi").dropDuplicates(["id"])
    return links.unionByName(linked(more.join(again, "id"), more.agg(F.sum("n_shingles")).first()[0] or 0, percent))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80).drop("text_key")
