"""Maximum-inner-product search by inverted lists and adaptive dimension scans (operator 6).

One more dimension turns the largest inner product into the smallest distance:
rows get what their length lacks to the largest one, queries get 0.  Rows go to
the list of their nearest centroid.  Lists are packed into cells of bounded
size; a list of many rows is dealt over several cells.  A query visits the cells
of its ``probes`` nearest lists, in blocks of about ``QUERY_ROWS`` queries of near
lists; a cell is sent to the blocks that visit it and to no others.
There all vectors are turned by one random rotation and laid out in blocks of
columns.  Each query scans its nearest list first, which gives it a limit; then
each list is scanned for all its queries together: after each block of columns,
a row whose partial distance to a query, carried to all dimensions, lies above
the query's limit by more than sampling error allows is abandoned.  Survivors get
their exact inner product in double precision on the original vectors.

Centroids are fitted on at most ``SAMPLE`` rows, those of the smallest hashes;
every row is indexed.  ``probes`` is the smallest number for which at most
``TUNE`` queries, compared with brute force over all rows, reach ``RECALL``, at
every size.

Rows take no part whose id or vector is null, whose vector is empty, zero, of
another length than most, or holds a null or a non-finite number.  Of rows of
one id the smallest vector counts.  Ties go to the smaller vec_id.  Extra columns
play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, tidied, written

K = 20
SAMPLE = 20_000
TUNE = 64
RECALL = 0.97
#: Rows of a cell.
CELL_ROWS = 8192
#: Queries of a group, about.
QUERY_ROWS = 1024
#: Partial distances, and pairs of full vectors, that a task holds at a time.
HELD_DISTANCES, HELD_PAIRS = 1 << 21, 1 << 16
#: Dimensions of a column block.
COLUMNS = 16
#: Standard deviations of a partial distance that a row must exceed to be abandoned.
CERTAINTY = 2.1
SEED = 7


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and v (bytes of double numbers), one row for each id that takes part."""
    e = F.col("e")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("e"))
    rows = rows.where(F.col("vec_id").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0))
    length = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("e") == (length[0]["n"] if length else 0)).groupBy("vec_id").agg(F.min("e").alias("e"))
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy().astype("<f8")
            size = 8 * (len(flat) // max(len(lists), 1))
            bounds = np.arange(len(lists) + 1, dtype=np.int32) * size
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])], schema=schema)

    return written(rows.mapInArrow(tidied(run), "vec_id long, v binary"), "vectors")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = [x.as_buffer() for x in column]
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)


@dataclass
class Index:
    """What every task needs: rotation, centroids, and where the rows of each list are."""

    longest: float
    rotation: np.ndarray
    centroids: np.ndarray
    sizes: np.ndarray = None
    first_cell: np.ndarray = None
    n_cells: np.ndarray = None
    probes: int = 1

    def turned(self, rows: np.ndarray, query: bool = False) -> np.ndarray:
        """Rows with their further dimension, rotated."""
        rest = np.zeros(len(rows)) if query else np.sqrt(np.maximum(self.longest - (rows * rows).sum(1), 0))
        return (np.concatenate([rows, rest[:, None]], 1) @ self.rotation).astype(np.float32)

    def distances(self, turned: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids, but for the row's own length."""
        return (self.centroids * self.centroids).sum(1) - 2 * (turned @ self.centroids.T)

    def probed(self, turned: np.ndarray, k: int) -> list[np.ndarray]:
        """Lists of each query, nearest first; as many more as it takes to see more than k rows."""
        order = np.argsort(self.distances(turned), 1, kind="stable")
        enough = (np.cumsum(self.sizes[order], 1) <= k).sum(1) + 1
        return [o[: max(self.probes, n)] for o, n in zip(order, enough)]

    def pack(self, sizes: np.ndarray, most: int = CELL_ROWS) -> None:
        self.sizes = sizes
        self.n_cells = np.maximum(1, -(-sizes // most))
        self.first_cell = np.zeros(len(sizes), np.int64)
        cell, room = -1, 0
        for i, size in enumerate(sizes):
            if size > most:
                continue
            if size > room:
                cell, room = cell + 1, most
            self.first_cell[i] = cell
            room -= size
        for i in np.flatnonzero(sizes > most):
            self.first_cell[i] = cell + 1
            cell += self.n_cells[i]


def k_means(rows: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centroids = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([np.argmin((centroids * centroids).sum(1) - 2 * (rows[i : i + 4096] @ centroids.T), 1) for i in range(0, len(rows), 4096)])
        total = np.zeros_like(centroids)
        np.add.at(total, nearest, rows)
        count = np.bincount(nearest, minlength=k)
        some = count > 0
        centroids[some] = total[some] / count[some, None]
    return centroids


def build(spark: SparkSession, base: DataFrame, k: int) -> tuple[Index, DataFrame]:
    """The index and its rows: list, vec_id, v."""
    n = base.count()
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    longest = base.mapInArrow(tidied(longest_of), "longest double").agg(F.max("longest")).first()[0] or 0.0
    rows = matrix(sample.column("v")) if n else np.zeros((0, 1))
    rotation = np.linalg.qr(np.random.default_rng(SEED).standard_normal((rows.shape[1] + 1,) * 2))[0]
    index = Index(longest, rotation, np.zeros((0, rows.shape[1] + 1), np.float32))
    turned = index.turned(rows)
    distinct = len(np.unique(turned, axis=0))
    index.centroids = k_means(turned, int(min(max(1, round(np.sqrt(n))), max(1, distinct // 8)))) if n else index.centroids
    shared = spark.sparkContext.broadcast(index)
    schema = pa.schema([("list", pa.int64()), ("vec_id", pa.int64()), ("v", pa.binary())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = np.argmin(shared.value.distances(shared.value.turned(matrix(batch.column(1)))), 1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), *batch.columns], schema=schema)

    listed = written(base.mapInArrow(tidied(assign), "list long, vec_id long, v binary"), "lists")
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in listed.groupBy("list").count().collect():  # a row for each list: at most SAMPLE / 8
        sizes[r["list"]] = r["count"]
    index.pack(sizes)
    index.probes = tuned_probes(spark, listed, index, k)
    return index, listed


def longest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array([float((rows * rows).sum(1).max())])], names=["longest"])


def exact(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products in double precision, row by row; equal rows get equal numbers wherever they stand."""
    return (rows * queries).sum(axis=1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def tuned_probes(spark: SparkSession, listed: DataFrame, index: Index, k: int) -> int:
    """Fewest lists that give the tuning queries enough of their true neighbours."""
    picked = listed.where("vec_id % 20 = 0").orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(TUNE).toArrow()
    if not picked.num_rows:
        return len(index.centroids)
    queries, ids = matrix(picked.column("v")), picked.column("vec_id").to_numpy()
    schema = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("list", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lists, own = matrix(batch.column(2)), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for q, (query, own_id) in enumerate(zip(queries, ids)):
                scores = np.where(own == own_id, -np.inf, rows @ query)
                at = best(scores, own, min(k, len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q)), pa.array(own[at]), pa.array(lists[at]), pa.array(scores[at])], schema=schema)

    found = listed.mapInArrow(tidied(run), "q long, vec_id long, list long, score double")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    true = found.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "list").collect()  # TUNE * k rows
    order = np.argsort(index.distances(index.turned(queries, query=True)), 1, kind="stable")
    place = np.argsort(order, 1)
    needed = np.sort([place[r["q"], r["list"]] for r in true])
    if not len(needed):
        return len(index.centroids)
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1


def scan(rows: np.ndarray, queries: np.ndarray, limit: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that the tests leave, of rotated vectors; ``limit``: the largest squared distance wanted of each query; ``slack`` covers rounding."""
    total = rows.shape[1]

    def bound(done: int) -> np.ndarray:
        return slack + (limit if done == total else limit * done / total * (1 + CERTAINTY / np.sqrt(done)) ** 2)

    so_far, pairs = np.zeros((len(queries), len(rows)), np.float32), None
    for first in range(0, total, COLUMNS):
        q, x = queries[:, first : first + COLUMNS], rows[:, first : first + COLUMNS]
        done = min(first + COLUMNS, total)
        if pairs is None:
            # all queries with all rows at once, as long as most of the pairs live
            so_far += (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * (q @ x.T)
            alive = so_far <= bound(done)[:, None]
            if 4 * np.count_nonzero(alive) < alive.size or done == total:
                pairs = np.nonzero(alive)
                so_far = so_far[pairs]
        else:
            for low in range(0, len(so_far), HELD_PAIRS):
                difference = q[pairs[0][low : low + HELD_PAIRS]] - x[pairs[1][low : low + HELD_PAIRS]]
                so_far[low : low + HELD_PAIRS] += np.einsum("ij,ij->i", difference, difference)
            alive = so_far <= bound(done)[pairs[0]]
            pairs, so_far = (pairs[0][alive], pairs[1][alive]), so_far[alive]
    return pairs


class Best:
    """The k best rows of each query so far: larger scores, then smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.ids = k, np.full((queries, k), -np.inf), np.zeros((queries, k), np.int64)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        hope = scores >= self.scores[query, -1]
        query, ids, scores = query[hope], ids[hope], scores[hope]
        if not len(query):
            return
        some = np.unique(query)
        owner = np.concatenate((np.repeat(some, self.k), query))
        ids = np.concatenate((self.ids[some].ravel(), ids))
        scores = np.concatenate((self.scores[some].ravel(), scores))
        order = np.lexsort((ids, -scores, owner))
        take = order[np.searchsorted(owner[order], some)[:, None] + np.arange(self.k)]
        self.ids[some], self.scores[some] = ids[take], scores[take]


def search_cell(index: Index, lists: np.ndarray, ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score: the best of this cell's probed lists for each query."""
    order = np.lexsort((ids, lists))
    lists, ids, rows = lists[order], ids[order], rows[order]
    turned, turned_queries = index.turned(rows), index.turned(queries, query=True)
    here, first = np.unique(lists, return_index=True)
    edges = {int(x): (a, b) for x, a, b in zip(here, first, np.append(first[1:], len(lists)))}
    length = (queries * queries).sum(1) + index.longest
    found = Best(len(queries), k)

    def visit(x: int, some: np.ndarray) -> None:
        a, b = edges[x]
        step = max(1, HELD_DISTANCES // (b - a))
        for part in (some[i : i + step] for i in range(0, len(some), step)):
            worst = found.scores[part, -1]
            limit = np.where(np.isfinite(worst), np.maximum(length[part] - 2 * worst, 0), np.inf)
            q, at = scan(turned[a:b], turned_queries[part], limit, 1e-5 * length[part])
            q, at = part[q], at + a
            other = ids[at] != query_ids[q]
            q, at = q[other], at[other]
            for low in range(0, len(q), HELD_PAIRS):
                own, row = q[low : low + HELD_PAIRS], at[low : low + HELD_PAIRS]
                found.add(own, ids[row], exact(rows[row], queries[own]))

    # the nearest list of each query in this cell, then the others
    rounds: tuple[dict, dict] = ({}, {})
    for i, probed in enumerate(index.probed(turned_queries, k)):
        for place, x in enumerate([x for x in probed.tolist() if x in edges]):
            rounds[place > 0].setdefault(x, []).append(i)
    for visits in rounds:
        for x, some in visits.items():
            visit(x, np.array(some))
    q, place = np.nonzero(np.isfinite(found.scores))
    return query_ids[q], found.ids[q, place], found.scores[q, place]


def near_blocks(centroids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A group of near lists for each list, and of each group its first block of queries and the number of its blocks."""
    groups = int(min(max(1, -(-int(queries.sum()) // QUERY_ROWS)), max(1, len(centroids))))
    group = np.zeros(len(centroids), np.int64)
    if groups > 1:
        middles = k_means(centroids, groups)
        group = np.argmin((middles * middles).sum(1) - 2 * (centroids @ middles.T), 1)
    parts = np.maximum(1, -(-np.bincount(group, queries, groups).astype(np.int64) // QUERY_ROWS))
    return group, np.cumsum(parts) - parts, parts


def search(embeddings: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query, those rows whose id ``every`` divides."""
    spark = embeddings.sparkSession
    index, listed = build(spark, vectors(embeddings), k)
    shared = spark.sparkContext.broadcast(index)
    asking = listed.where(F.col("vec_id") % every == 0)
    counts = np.zeros(len(index.centroids), np.int64)
    for r in asking.groupBy("list").count().collect():  # a row for each list: at most SAMPLE / 8
        counts[r["list"]] = r["count"]
    group, first, parts = near_blocks(index.centroids, counts)
    cell_schema = pa.schema([("cell", pa.int64()), ("list", pa.int64()), ("vec_id", pa.int64()), ("v", pa.binary())])

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # rows of a long list are dealt over its cells by id
            cells = pa.array(shared.value.first_cell[lists] + (ids * np.int64(0x9E3779B1) >> np.int64(7)) % shared.value.n_cells[lists])
            yield pa.RecordBatch.from_arrays([cells, *batch.columns], schema=cell_schema)

    query_schema = pa.schema([("cell", pa.int64()), ("block", pa.int64()), ("query_id", pa.int64()), ("v", pa.binary())])

    def to_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            probed = ix.probed(ix.turned(matrix(batch.column(2)), query=True), k)
            cells = [np.unique(np.concatenate([np.arange(ix.first_cell[x], ix.first_cell[x] + ix.n_cells[x]) for x in lists])) for lists in probed]
            at = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
            own = group[batch.column(0).to_numpy()]
            block = (first[own] + batch.column(1).to_numpy() // every % parts[own])[at]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(block), batch.column(1).take(pa.array(at)), batch.column(2).take(pa.array(at))], schema=query_schema)

    def visit(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            found = search_cell(shared.value, rows.column("list").to_numpy(), rows.column("vec_id").to_numpy(), matrix(rows.column("v")), queries.column("query_id").to_numpy(), matrix(queries.column("v")), k)
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("query_id", "vec_id", "score"), found, (pa.int64(), pa.int64(), pa.float64()))})

    visits = written(asking.select("list", "vec_id", "v").mapInArrow(tidied(to_visits), "cell long, block long, query_id long, v binary"), "visits")
    visited = written(visits.select("cell", "block").distinct(), "visited-cells")
    cells = listed.mapInArrow(tidied(to_cells), "cell long, list long, vec_id long, v binary").join(visited, "cell").select("cell", "block", "list", "vec_id", "v")
    found = cells.groupBy("cell", "block").cogroup(visits.groupBy("cell", "block")).applyInArrow(visit, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
