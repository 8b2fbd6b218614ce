"""Fill-in-middle transformation (operator 11).

One table-driven automaton reads the bytes of whole texts.  Its states tell how
many continuation bytes are due (with the ranges that UTF-8 allows for them) and
how much of a sentinel has been seen; a transition emits one count where a unit
(a code point) ends, one where a sentinel ends and one where bytes are no UTF-8.
Texts are cut into lanes of ``LANE`` bytes, and all lanes advance by one byte at a
time.  The automaton's state depends on the three bytes before, so each lane
starts with those and needs no other lane.  Sums of a text's lanes give its units,
its sentinels and its errors; a second pass locates cuts: running sums name a cut's
lane, and that lane alone is read again up to the unit.

A text's form and cuts come from a hash of its id: prefix, middle and suffix are
its units up to the smaller draw, up to the larger and the rest.  ``plain`` is the
text as it is; ``psm`` is prefix, suffix, middle and ``spm`` suffix, prefix,
middle, each after its sentinel.  No sentinel can arise where parts meet, as none
starts with another's end; so a cut text is restored by its sentinels.

Null and empty texts are plain and empty.  Texts with a sentinel are plain.  Texts
of any length are read whole, slice by slice or alone.  Bytes that are no UTF-8
(a string column may hold such) are replaced by U+FFFD first.  A null id counts as
the empty text in the hash.  Equal rows have equal results and all stay; extra
columns play no part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import raw_of, slices, table, texts_of, tidied

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of 100 texts so many are cut; of 100 cut ones so many have the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
LANE = 512
#: Bytes before a lane that determine the state at its start.
WARM = 3

#: Byte that never occurs in UTF-8: it fills lanes up and emits nothing.
FILL = 0xFF
#: States: at a unit's start; 1, 2, 3 continuation bytes due; second bytes of narrower ranges due; a sentinel's first and first two bytes seen.
START, ONE, TWO, THREE, AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4, OPENED, NAMED = range(10)
#: What a transition counts: a number for each sort, packed into one.
UNIT, SENTINEL, ERROR = 1, 1 << 20, 1 << 40
MASK = (1 << 20) - 1


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next states and counts, both by state * 256 + byte."""
    step = np.full((10, 256), START, np.uint16)
    count = np.full((10, 256), ERROR, np.int64)
    # a unit's first byte: at a start, or where a sentinel may go on but doesn't
    for state in (START, OPENED, NAMED):
        count[state, :0x80] = UNIT
        for first, last, to in ((0xC2, 0xDF, ONE), (0xE0, 0xEF, TWO), (0xF0, 0xF4, THREE)):
            step[state, first : last + 1], count[state, first : last + 1] = to, 0
        for byte, to in ((0xE0, AFTER_E0), (0xED, AFTER_ED), (0xF0, AFTER_F0), (0xF4, AFTER_F4)):
            step[state, byte] = to
        step[state, ord("<")] = OPENED
    for name in (PREFIX, SUFFIX, MIDDLE):
        step[OPENED, ord(name[1])] = NAMED
    count[NAMED, ord(">")] = UNIT | SENTINEL
    # continuation bytes; only the last one ends a unit
    due = ((ONE, 0x80, 0xBF, START), (TWO, 0x80, 0xBF, ONE), (THREE, 0x80, 0xBF, TWO), (AFTER_E0, 0xA0, 0xBF, ONE), (AFTER_ED, 0x80, 0x9F, ONE), (AFTER_F0, 0x90, 0xBF, TWO), (AFTER_F4, 0x80, 0x8F, TWO))
    for state, first, last, to in due:
        step[state, first : last + 1], count[state, first : last + 1] = to, UNIT if to == START else 0
    # a text that ends within a unit is an error of its own
    for state in range(10):
        step[state, FILL], count[state, FILL] = START, 0 if state in (START, OPENED, NAMED) else ERROR
    return (step * 256).ravel(), count.ravel()


STEP, COUNT = automaton()


class Scan:
    """The first pass over some texts; ``cuts`` is the second."""

    def __init__(self, texts: pa.StringArray):
        data, offsets = raw_of(texts)
        lengths = np.diff(offsets)
        # each text has a byte of filling at least, which ends an unfinished unit
        self.lanes = lengths // LANE + 1
        self.first = np.cumsum(self.lanes) - self.lanes
        # texts start at lanes, so one row holds WARM bytes of the row before and its own
        flat = np.full(int(self.lanes.sum()) * LANE + WARM, FILL, np.uint8)
        for to, start, stop in zip((self.first * LANE + WARM).tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            flat[to : to + stop - start] = data[start:stop]
        self.rows = np.lib.stride_tricks.as_strided(flat, (int(self.lanes.sum()), LANE + WARM), (LANE, 1))
        counts = np.zeros(len(self.rows), np.int64)
        state = self._warm(self.rows)
        for j in range(WARM, LANE + WARM):
            at = state + self.rows[:, j]
            counts += COUNT[at]
            state = STEP[at]
        self.units_of_lanes = counts & MASK
        total = [np.add.reduceat(x, self.first) if len(texts) else np.zeros(0, np.int64) for x in (counts & MASK, (counts >> 20) & MASK, counts >> 40)]
        self.units, self.sentinels, self.errors = total
        self.before = np.cumsum(self.units_of_lanes) - self.units_of_lanes

    @staticmethod
    def _warm(rows: np.ndarray) -> np.ndarray:
        state = np.zeros(len(rows), np.uint16)
        for j in range(WARM):
            state = STEP[state + rows[:, j]]
        return state

    def cuts(self, text: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Byte offset in each ``text`` (index) after its first ``units`` units."""
        out = np.zeros(len(text), np.int64)
        some = np.flatnonzero(units > 0)
        wanted = self.before[self.first[text[some]]] + units[some]
        # the last lane with fewer units before it than wanted
        lane = np.searchsorted(self.before, wanted, side="left") - 1
        left = wanted - self.before[lane]
        rows = self.rows[lane]
        state, found = self._warm(rows), np.zeros(len(some), np.int64)
        for j in range(WARM, LANE + WARM):
            at = state + rows[:, j]
            left -= COUNT[at] & UNIT
            found[(left == 0) & (found == 0)] = j - WARM + 1
            state = STEP[at]
        out[some] = (lane - self.first[text[some]]) * LANE + found
        return out


def repaired(texts: pa.StringArray) -> pa.StringArray:
    """Texts with U+FFFD for bytes that are no UTF-8."""
    return pa.array([x.as_py().decode("utf-8", "replace") for x in texts.cast(pa.binary())], pa.string())


SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def formed(texts: pa.StringArray, h: list[np.ndarray]) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of each text, by its four hash values."""
    scan = Scan(texts)
    if scan.errors.any():
        texts = repaired(texts)
        scan = Scan(texts)
    n = scan.units
    draws = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
    plain = (n == 0) | (scan.sentinels > 0) | (h[2] % 100 >= CUT_PERCENT)
    suffix_first = ~plain & (h[3] % 100 < SUFFIX_FIRST_PERCENT)
    cut = np.flatnonzero(~plain)
    ends = np.zeros((2, len(texts)), np.int64)
    for k in range(2):
        ends[k, cut] = scan.cuts(cut, draws[k, cut])
    data, offsets = raw_of(texts)
    raw, out = data.tobytes(), []
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    for i, (start, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if plain[i]:
            out.append(raw[start:stop])
            continue
        a, b = start + int(ends[0, i]), start + int(ends[1, i])
        out.append(b"".join((s, raw[b:stop], p, raw[start:a], m, raw[a:b]) if suffix_first[i] else (p, raw[start:a], s, raw[b:stop], m, raw[a:b])))
    form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
    return [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(draws[0], pa.int64(), mask=plain), pa.array(draws[1] - draws[0], pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())]


def draws_of(key: Column, seed: int = SEED) -> list[Column]:
    """Four 32-bit numbers of the hash of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output (the example's text) of each row of ``docs`` (doc_id, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    given = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"), *draws_of(docs["doc_id"], seed))
    out = given.sparkSession.createDataFrame([], given.select("doc_id").schema).select("doc_id", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in SCHEMA.split(", "))).schema
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            h = [batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(4)]
            for first, last in slices(texts):
                part = formed(texts.slice(first, last - first), [x[first:last] for x in h])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *part], schema=schema)

    return given.mapInArrow(tidied(run), out)


def restored(output: Column, form: Column) -> Column:
    """The text that an example was made of."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(F.col("doc_id").cast("long").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_OP11 = f"""
with hashed as (select doc_id, coalesce(text, '') as text, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as d from documents),
drawn as (select doc_id, text, length(text) as n, ('0x' || d[1:8])::bigint as h1, ('0x' || d[9:16])::bigint as h2, ('0x' || d[17:24])::bigint as h3, ('0x' || d[25:32])::bigint as h4 from hashed),
cut as (select doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when n = 0 or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or h3 % 100 >= {CUT_PERCENT} then 'plain' when h4 % 100 < {SUFFIX_FIRST_PERCENT} then 'spm' else 'psm' end as form from drawn),
made as (select *, case form when 'plain' then text
  when 'psm' then '{PREFIX}' || substr(text, 1, a) || '{SUFFIX}' || substr(text, b + 1, n - b) || '{MIDDLE}' || substr(text, a + 1, b - a)
  else '{SUFFIX}' || substr(text, b + 1, n - b) || '{PREFIX}' || substr(text, 1, a) || '{MIDDLE}' || substr(text, a + 1, b - a) end as output from cut)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a end::bigint as prefix_chars, case when form <> 'plain' then b - a end::bigint as middle_chars,
  sha256(output) as output_sha256, sha256(text) as restored_sha256 from made
"""
