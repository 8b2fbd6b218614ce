"""Benchmark decontamination by latent semantic retrieval (operator 10).

1. Texts become sequences of term numbers, in one pass over the corpus.  The
   vocabulary is that of all benchmark items; other words have number -1.
2. A passage is ``STEP`` words.  Document frequencies of terms are counted over
   all passages of all documents, those without any term too; a term's weight is
   ln((2 + passages) / (1 + passages with the term)), above 0 however common it is.
3. A randomised singular value decomposition of the passages' TF-IDF matrix A:
   every task adds up its part of A'(A R) for a random R; the sum and R give the
   leading singular vectors (Nystroem's way).  The sum is as wide as the
   vocabulary and the rank, whatever the corpus.
   A term counts once in a passage or an item, so repeated words drown nothing.
4. Windows of two passages and items are compared by cosine in the latent space.
5. A window near an item must hold ``HELD`` of the item's weighted terms (as far
   as a window can hold them); then it is confirmed on the words around it: the
   longest common subsequence with the item must reach ``SURE`` of the item's words, or
   ``LIKELY`` of them where also enough of the item's answer is there.  The
   answer is the column of that name; without one, the item's rarest terms.
6. Whatever the cosine, places with enough of an item's runs of ``RUN`` words go
   to the same confirmation: as many as stay if the share of words that ``SURE``
   allows is replaced or left out.  No such copy is lost.

Vocabulary, weights and singular vectors are those of the whole benchmark, which the
driver holds as numbers.  Items are matched ``ITEMS`` at a time against the table of
term numbers, so what goes to the tasks at once is bounded; rows and values are the
same for any such number.
Items without a word, with null id or null text match nothing.  Null and empty
texts match nothing; texts of any length are searched whole; rows with a null
doc_id aren't reported; repeated rows are reported once; extra columns play no
part; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, ranges, slices, table, texts_of, tidied, tidied_group, words_of, written

ITEMS = 20_000
STEP = 16
RANK, OVERSAMPLE = 128, 8
NEAR = 0.25
HELD = 0.4
SURE, LIKELY, ANSWERED = 0.8, 0.6, 0.6
#: Words of a run; items under LONG words, where changes may leave no such run, have runs of SHORT_RUN.
RUN, SHORT_RUN, LONG = 3, 2, 15
#: Bits of the filter that runs pass before they are looked up.
FILTER_BITS = 21
#: Windows and items that are compared at a time.
WINDOWS, ITEM_BLOCK = 4096, 512
#: Rarest terms that stand for the answer of an item without one.
ANSWER_TERMS = 5
SEED = 11
#: Vocabulary rows that one partial sum row carries.
TERMS_A_ROW = 256


ID_TYPES = {"long": pa.int64(), "string": pa.string()}


@dataclass
class Items:
    """Benchmark items as sequences of term numbers."""

    ids: list[int]
    terms: list[np.ndarray]
    answers: list[np.ndarray | None]
    vocabulary: pa.BinaryArray

    def part(self, first: int, last: int) -> Items:
        return Items(self.ids[first:last], self.terms[first:last], self.answers[first:last], self.vocabulary)


def terms_of(texts: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """Words in lower case of any script, without ASCII punctuation."""
    return words_of(pc.utf8_lower(texts), SEPARATORS)


def read_items(rows: Iterable) -> Items:
    """All items of some rows (item_id, text, answer), numbered by one vocabulary."""
    number: dict[bytes, int] = {}
    out = Items([], [], [], pa.array([], pa.binary()))
    for r in rows:
        if r["item_id"] is None or not r["text"]:
            continue
        both = [terms_of(pa.array([x], pa.string()))[0].to_pylist() for x in (r["text"], r["answer"] or "")]
        terms, answer = (np.array([number.setdefault(w, len(number)) for w in words], np.int32) for words in both)
        if len(terms):
            out.ids.append(r["item_id"])
            out.terms.append(terms)
            out.answers.append(answer if len(answer) else None)
    out.vocabulary = pa.array(list(number), pa.binary())
    return out


def sequences(docs: DataFrame, vocabulary: pa.BinaryArray, id_type: str = "long") -> DataFrame:
    """doc_id, terms (little-endian 32-bit numbers; null without any term of the vocabulary) and passages of each document."""
    schema = pa.schema([("doc_id", ID_TYPES[id_type]), ("terms", pa.binary()), ("passages", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for first, last in slices(texts):
                words, at = terms_of(texts.slice(first, last - first))
                coded = words.dictionary_encode()
                known = pc.index_in(coded.dictionary, value_set=vocabulary).fill_null(-1).to_numpy().astype("<i4")
                numbers = known[coded.indices.to_numpy()] if len(words) else np.zeros(0, "<i4")
                raw = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(numbers)])
                hits = np.concatenate(([0], np.cumsum(numbers >= 0)))
                some = pa.array(np.diff(hits[at]) > 0)
                passages = pa.array(-(-np.diff(at) // STEP))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pc.if_else(some, raw, None), passages], names=schema.names).cast(schema)

    return written(docs.where(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast(id_type), docs["text"].cast("string")).mapInArrow(tidied(run), f"doc_id {id_type}, terms binary, passages long"), "term-numbers")


def parts(batch: pa.RecordBatch, column: int, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First and last row, terms, each row's first term and each row's first passage (one more at the end), for slices of bounded size."""
    raws = [x.as_buffer() for x in batch.column(column)]
    sizes = np.fromiter((len(x) >> 2 for x in raws), np.int64, len(raws))
    first = 0
    while first < len(raws):
        last = min(len(raws), first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), most))))
        own = sizes[first:last]
        terms = np.frombuffer(b"".join(raws[first:last]), "<i4")
        yield first, last, terms, np.concatenate(([0], np.cumsum(own))), np.concatenate(([0], np.cumsum(-(-own // STEP))))
        first = last


def passages_of(at: np.ndarray, starts: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """The passage that each of some ascending places of a slice is in."""
    row = np.searchsorted(starts, at, side="right") - 1
    return passages[row] + (at - starts[row]) // STEP


def passage_counts(stored: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """Passages in all, and passages with each term; each task sends the terms that it has met."""
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, terms, starts, passages in parts(batch, 0):
                at = np.flatnonzero(terms >= 0)
                pairs = passages_of(at, starts, passages) * size + terms[at]
                if int(passages[-1]) * size < 1 << 31:
                    pairs = pairs.astype(np.int32)
                pairs.sort()
                first = np.concatenate(([True], pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, bool)
                total += np.bincount(pairs[first] % size, minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], schema=schema)

    rows = stored.where("terms is not null").select("terms").mapInArrow(tidied(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term of the items
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return stored.agg(F.sum("passages").alias("n")).first()["n"] or 0, out


def weighted(terms: np.ndarray, weights: np.ndarray, starts: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms with a weight, once for each passage that holds them, and the passage of each."""
    at = np.flatnonzero((terms >= 0) & (weights[terms] > 0))
    pairs = passages_of(at, starts, passages) * len(weights) + terms[at]
    pairs.sort()
    pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))] if len(pairs) else pairs
    return pairs % len(weights), pairs // len(weights)


def group_sums(table: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the table's rows at ``index``, from each of some places up to the next."""
    sizes = np.diff(np.append(first, len(index)))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = first[order], sizes[order]
    out = table[index[starts]]
    room = np.empty_like(out)
    for k in range(1, min(2 * STEP, int(sizes.max(initial=0)))):
        n = int(np.searchsorted(-sizes, -k))
        np.take(table, index[starts[:n] + k], axis=0, out=room[:n], mode="clip")
        out[:n] += room[:n]
    for g in np.flatnonzero(sizes > 2 * STEP).tolist():
        out[g] += table[index[starts[g] + 2 * STEP : starts[g] + sizes[g]]].sum(0)
    back = np.empty_like(out)
    back[order] = out
    return back


def latent(terms: np.ndarray, passage: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages that have any of the terms, and the sums of their terms' basis rows."""
    if not len(terms):
        return passage, np.zeros((0, basis.shape[1]), np.float32)
    first = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    return passage[first], group_sums(basis, terms, first)


def summed(rows: DataFrame, size: int, width: int) -> np.ndarray:
    """Sums of partial rows (part, terms, values: bytes of term numbers and of their rows of doubles), by term."""

    def add(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        total = np.zeros((TERMS_A_ROW, width))
        for terms, values in zip(group["terms"], group["values"]):
            total[np.frombuffer(terms.as_buffer(), "<i4") - part] += np.frombuffer(values.as_buffer(), "<f8").reshape(-1, width)
        return pa.table({"part": pa.array([part], pa.int64()), "values": pa.array([total.tobytes()])})

    out = np.zeros((-(-size // TERMS_A_ROW) * TERMS_A_ROW, width))
    for r in rows.groupBy("part").applyInArrow(tidied_group(add), "part long, values binary").collect():  # as wide as vocabulary and rank
        out[r["part"] : r["part"] + TERMS_A_ROW] = np.frombuffer(r["values"], "<f8").reshape(-1, width)
    return out[:size]


def decompose(stored: DataFrame, weights: np.ndarray, rank: int) -> np.ndarray:
    """Weighted right singular vectors: a passage's latent row is the sum of its terms' rows."""
    spark = stored.sparkSession
    size, width = len(weights), rank + OVERSAMPLE
    start = np.random.default_rng(SEED).standard_normal((size, width)).astype(np.float32)
    shared = spark.sparkContext.broadcast((weights.astype(np.float32), start * weights[:, None].astype(np.float32)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, basis = shared.value
        total = np.zeros((size, width))
        for batch in batches:
            for _, _, terms, starts, passages in parts(batch, 0):
                terms, passage = weighted(terms, w, starts, passages)
                if len(terms):
                    known, rows = latent(terms, passage, basis)
                    row = np.searchsorted(known, passage)
                    order = np.argsort(terms)
                    at = terms[order]
                    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                    total[at[first]] += group_sums(rows, row[order], first) * w[at[first], None]
        # only the terms that the task has met
        seen = np.flatnonzero(total.any(1))
        for part in np.unique(seen // TERMS_A_ROW) * TERMS_A_ROW:
            own = seen[(seen >= part) & (seen < part + TERMS_A_ROW)].astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([own.tobytes()], pa.binary()), pa.array([total[own].tobytes()], pa.binary())], names=["part", "terms", "values"])

    total = summed(stored.where("terms is not null").select("terms").mapInArrow(tidied(sketch), "part long, terms binary, values binary"), size, width)
    return leading(total, start.astype(np.float64), weights, rank)


def leading(total: np.ndarray, start: np.ndarray, weights: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of A'A, each scaled by the terms' weights, from its product ``total`` with ``start`` alone (Nystroem)."""
    shift = np.finfo(np.float64).eps * math.sqrt(len(total)) * max(np.linalg.norm(total), 1e-30)
    moved = total + shift * start
    inner = start.T @ moved
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    some = values > values[-1] * 1e-12
    left, _, _ = np.linalg.svd(moved @ (vectors[:, some] / np.sqrt(values[some])), full_matrices=False)
    return (left[:, :rank] * weights[:, None]).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


class Matcher:
    """Longest common subsequence with one item, on bits: a bit for each of the item's words."""

    def __init__(self, item: np.ndarray, answer: np.ndarray):
        self.size, self.full = len(item), (1 << len(item)) - 1
        self.masks: dict[int, int] = {}
        for i, t in enumerate(item.tolist()):
            self.masks[t] = self.masks.get(t, 0) | 1 << i
        self.answer = set(answer.tolist())

    def share(self, words: list[int]) -> float:
        row, masks = self.full, self.masks
        for t in words:
            mask = masks.get(t)
            if mask:
                both = row & mask
                row = ((row + both) | (row - both)) & self.full
        return (self.size - row.bit_count()) / self.size

    def answered(self, words: list[int]) -> float:
        return len(self.answer.intersection(words)) / len(self.answer) if self.answer else 1.0


def run_numbers(terms: np.ndarray, length: int, base: int) -> np.ndarray:
    """The number of the run of some words that begins at each place."""
    count = max(0, len(terms) - length + 1)
    out = terms[:count].astype(np.int64) + 1
    for k in range(1, length):
        out = out * base + (terms[k : k + count] + 1)
    return out


class Runs:
    """Runs of the items' words, of one length for long items and one for short ones."""

    def __init__(self, item_terms: list[np.ndarray], size: int):
        self.base, self.sizes, self.groups = size + 1, [len(t) for t in item_terms], []
        lengths = [RUN if n >= LONG else min(n, SHORT_RUN) for n in self.sizes]
        # a changed word breaks as many runs as a run has words
        self.least = np.array([max(1, n - k + 1 - (n - math.ceil(SURE * n)) * k) for n, k in zip(self.sizes, lengths)], np.int64)
        for length in sorted(set(lengths)):
            own = [i for i, k in enumerate(lengths) if k == length]
            runs = [run_numbers(item_terms[i], length, self.base) for i in own]
            order = np.argsort(numbers := np.concatenate(runs), kind="stable")
            known, at = np.unique(numbers[order], return_index=True)
            item = np.repeat(own, [len(r) for r in runs])[order]
            offset = np.concatenate([np.arange(len(r)) for r in runs])[order]
            some = np.zeros(1 << FILTER_BITS, bool)
            some[self.slot(known)] = True
            self.groups.append((length, known, np.append(at, len(order)), item, offset, some))

    @staticmethod
    def slot(numbers: np.ndarray) -> np.ndarray:
        return (numbers.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)

    def places(self, terms: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """Row, item and middles of the places where the item may stand."""
        for length, known, at, item, offset, some in self.groups:
            numbers = run_numbers(terms, length, self.base)
            place = np.flatnonzero(some[self.slot(numbers)])
            run = np.minimum(np.searchsorted(known, numbers[place]), len(known) - 1)
            row = np.searchsorted(starts, place, side="right") - 1
            there = (known[run] == numbers[place]) & (place + length <= starts[row + 1])
            place, run, row = place[there], run[there], row[there]
            if not len(place):
                continue
            distinct = np.unique(row * len(known) + run)
            rows, runs = distinct // len(known), distinct % len(known)
            many = at[runs + 1] - at[runs]
            entry = np.repeat(at[runs] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            pairs, counts = np.unique(np.repeat(rows, many) * len(self.sizes) + item[entry], return_counts=True)
            for pair in pairs[counts >= self.least[pairs % len(self.sizes)]].tolist():
                r, i = divmod(pair, len(self.sizes))
                low, high = np.searchsorted(row, [r, r + 1])
                own = run[low:high]
                many = at[own + 1] - at[own]
                entry = np.repeat(at[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                mine = item[entry] == i
                first = np.repeat(place[low:high], many)[mine] - offset[entry[mine]]
                yield r, i, (np.unique(first // STEP) * STEP + (STEP + self.sizes[i]) // 2).tolist()


def matches(stored: DataFrame, items: Items, weights: np.ndarray, basis: np.ndarray, id_type: str = "long") -> DataFrame:
    """doc_id, item_id, cosine, lcs_share of confirmed leaks."""
    rarest = [t[np.argsort(-weights[t], kind="stable")] for t in items.terms]
    answers = [a if a is not None else np.array(list(dict.fromkeys(r.tolist()))[:ANSWER_TERMS]) for a, r in zip(items.answers, rarest)]
    distinct = [np.unique(t) for t in items.terms]
    numbers = np.repeat(np.arange(len(items.ids)), [len(t) for t in distinct])
    targets = unit(latent(np.concatenate(distinct), numbers, basis)[1])
    shared = stored.sparkSession.sparkContext.broadcast((weights, basis, targets, items.ids, items.terms, answers))
    schema = pa.schema([("doc_id", ID_TYPES[id_type]), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, basis, targets, ids, item_terms, answers = shared.value
        distinct = [np.unique(t) for t in item_terms]
        needed = HELD * np.fromiter(map(len, distinct), np.float64, len(ids)) * np.minimum(1, 2 * STEP / np.fromiter(map(len, item_terms), np.float64, len(ids)))
        holders: dict[int, np.ndarray] = {}

        def held_by(low: int) -> np.ndarray:
            """For each term, which of a block of items hold it; one block's table is kept."""
            if low not in holders:
                holders.clear()
                holders[low] = np.zeros((len(weights), min(ITEM_BLOCK, len(ids) - low)), np.uint8)
                for i, t in enumerate(distinct[low : low + ITEM_BLOCK]):
                    holders[low][t, i] = 1
            return holders[low]

        def cosine_of(window: np.ndarray, item: int) -> float:
            return round(float(window.astype(np.float64) @ targets[item].astype(np.float64)), 6)

        matchers: dict[int, Matcher] = {}
        runs = Runs(item_terms, len(weights))

        def confirm(out: dict[tuple[int, int], tuple[float, float]], terms: np.ndarray, starts: np.ndarray, doc: int, i: int, middle: int, reach: int, cosine: float) -> None:
            if out.get((doc, i), (0, 0))[1] == 1:
                return
            if i not in matchers:
                matchers[i] = Matcher(item_terms[i], answers[i])
            words = terms[max(int(starts[doc]), middle - reach) : max(0, min(int(starts[doc + 1]), middle + reach))].tolist()
            share = matchers[i].share(words)
            if share >= SURE or share >= LIKELY and matchers[i].answered(words) >= ANSWERED:
                out[doc, i] = max(out.get((doc, i), (0.0, 0.0)), (cosine, share), key=lambda x: x[1])

        for batch in batches:
            for first, last, terms, starts, passages in parts(batch, 1):
                some, passage = weighted(terms, weights, starts, passages)
                known, rows = latent(some, passage, basis)
                # a window is a passage with the next one of its document
                row_of = np.repeat(np.arange(last - first), np.diff(passages))
                windows = np.unique(np.concatenate([known, known[known > passages[row_of[known]]] - 1])) if len(known) else known
                where = np.searchsorted(known, np.stack([windows, windows + 1]))
                sums = np.zeros((len(windows), basis.shape[1]), np.float32)
                for k, at in enumerate(where):
                    there = np.flatnonzero(at < len(known))
                    there = there[(known[at[there]] == windows[there] + k) & (row_of[known[at[there]]] == row_of[windows[there]])]
                    sums[there] += rows[at[there]]
                sums = unit(sums)
                # distinct terms of each window
                own_window = np.searchsorted(windows, passage)
                before = np.searchsorted(windows, passage - 1)
                there = np.flatnonzero((before < own_window) & (row_of[passage - 1] == row_of[passage]))
                window_terms = np.concatenate([own_window * len(weights) + some, before[there] * len(weights) + some[there]])
                window_terms.sort()
                window_terms = window_terms[np.concatenate(([True], window_terms[1:] != window_terms[:-1]))] if len(window_terms) else window_terms
                window_at = np.searchsorted(window_terms, np.arange(len(windows) + 1) * len(weights))
                window_terms %= len(weights)
                out: dict[tuple[int, int], tuple[float, float]] = {}
                for block in range(0, len(ids), ITEM_BLOCK):
                    holding = held_by(block)
                    # always as many columns, so that products don't depend on the number of items
                    own = np.zeros((ITEM_BLOCK, targets.shape[1]), np.float32)
                    own[: len(ids) - block] = targets[block : block + ITEM_BLOCK]
                    for low in range(0, len(sums), WINDOWS):
                        near = (sums[low : low + WINDOWS] @ own.T)[:, : len(ids) - block]
                        some_near = np.flatnonzero((near >= NEAR).any(1))
                        if not len(some_near):
                            continue
                        at = window_at[low + some_near]
                        counts = window_at[low + some_near + 1] - at
                        held = group_sums(holding, window_terms[ranges(at, counts)], np.cumsum(counts) - counts)
                        w, i = np.nonzero((held >= needed[block : block + ITEM_BLOCK]) & (near[some_near] >= NEAR))
                        for v, item in zip(some_near[w].tolist(), i.tolist()):
                            p = int(windows[low + v])
                            doc = int(row_of[p])
                            middle = int(starts[doc]) + (p - int(passages[doc])) * STEP + STEP
                            confirm(out, terms, starts, doc, block + item, middle, max(STEP, len(item_terms[block + item])), cosine_of(sums[low + v], block + item))
                for doc, item, middles in runs.places(terms, starts):
                    for middle in middles:
                        p = int(passages[doc]) + min(max(0, (middle - int(starts[doc]) - STEP // 2) // STEP), int(passages[doc + 1] - passages[doc]) - 1)
                        v = int(np.searchsorted(windows, p))
                        cosine = cosine_of(sums[v], item) if v < len(windows) and windows[v] == p else 0.0
                        confirm(out, terms, starts, doc, item, middle, max(STEP, len(item_terms[item])) + STEP // 2, cosine)
                if out:
                    doc_ids = batch.column(0)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_ids[first + d].as_py() for d, _ in out], schema.types[0]), pa.array([ids[i] for _, i in out]), pa.array([c for c, _ in out.values()]), pa.array([s for _, s in out.values()])], schema=schema)

    return stored.where("terms is not null").select("doc_id", "terms").mapInArrow(tidied(run), f"doc_id {id_type}, item_id long, cosine double, lcs_share double")


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, id_type: str = "long") -> DataFrame:
    """doc_id (of ``id_type``: long or string), item_id, cosine, lcs_share: a row for each document and each benchmark item that it contains."""
    spark = docs.sparkSession
    answer = benchmark["answer"].cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text"), answer.alias("answer")).toLocalIterator()
    items = read_items(rows)
    if not items.ids:
        return spark.createDataFrame([], f"doc_id {id_type}, item_id long, cosine double, lcs_share double")
    stored = sequences(docs, items.vocabulary, id_type)
    passages, with_term = passage_counts(stored, len(items.vocabulary))
    weights = np.log((2 + passages) / (1 + with_term))
    basis = decompose(stored, weights, rank)
    found = None
    for first in range(0, len(items.ids), ITEMS):
        part = matches(stored, items.part(first, first + ITEMS), weights, basis, id_type)
        found = part if found is None else found.unionByName(part)
    return written(found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs_share").alias("lcs_share")), "leaks")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
