"""Tables of units that are replaced as a whole, with a signed mark each: a data source to write and to read.

    spark.dataSource.register(Units)
    df.write.format("units").mode("append").options(path=..., unit="model", signature=...).save()
    spark.read.format("units").options(path=..., signature=..., order="row_id").load()

Writing: a task writes the rows of its units one after another to files of at most ``shard`` rows,
and beside each file notes: for each unit in it the mark, with the place and number of the unit's
rows, their first and last value of the order column, the file's digest, and the signature of the
inputs.  When all tasks have succeeded, the commit names their files in one list, which appears by
a rename; so the units of a run are there once and whole, or not at all, and of several lists that have a
unit, the last holds.  A failed or repeated run leaves no row twice.  There are as many files as
tasks and shards need, whatever the number of units.  Lists of which no unit is in force are removed with their files by
the next commit; files of killed tasks, which nothing names, stay.

Reading: before anything is planned, a folder without the expected marks, and a mark of another
signature, are errors; so are missing files.  Rows outside the range of the order
column are left out file by file, by the options ``first`` and ``last``.  Each file is a partition, of which
the rows of units in force are read.

The path is one that driver and workers share, a local path or a URI that Arrow opens.
Null units are written as such (``unit`` null in the mark).  An empty table publishes nothing.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Folders of the lists of commits, and of rows with their notes.
LISTS, ROWS = "marks", "rows"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def name_of(unit: object) -> str:
    """A folder's name for a unit's value."""
    return "unit-" + hashlib.sha256(json.dumps(unit, default=str).encode()).hexdigest()[:24]


def publish(store: fs.FileSystem, path: str, data: bytes) -> None:
    """A whole file under its name, or none: written beside it and renamed."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(beside) as out:
        out.write(data)
    store.move(beside, path)


def read_json(store: fs.FileSystem, path: str) -> dict | list:
    with store.open_input_stream(path) as given:
        return json.loads(given.read())


def lists(store: fs.FileSystem, root: str) -> list[dict]:
    """Lists of commits, the oldest first: schema, names of files."""
    found = store.get_file_info(fs.FileSelector(f"{root}/{LISTS}", allow_not_found=True))
    return [read_json(store, f.path) | {"path": f.path} for f in sorted(found, key=lambda f: f.base_name) if f.base_name.endswith(".json")]


def noted(store: fs.FileSystem, root: str, given: dict) -> dict[str, dict]:
    """Marks by name of a list of files."""
    out: dict[str, dict] = {}
    for file in given["files"]:
        for n in read_json(store, f"{root}/{ROWS}/{file}.json"):
            mark = out.setdefault(n["name"], {"unit": n["unit"], "schema": given["schema"], "signature": n["signature"], "files": [], "folder": f"{root}/{ROWS}"})
            if n["signature"] != mark["signature"]:
                raise ValueError(f"unit {n['unit']} has several signatures")
            mark["files"].append({k: n[k] for k in ("file", "at", "rows", "first", "last", "sha256")})
    return out


def marks(path: str) -> list[dict]:
    """The marks in force of a folder, by unit."""
    store, root = opened(path)
    found: dict[str, dict] = {}
    for x in lists(store, root):
        found |= noted(store, root, x)
    return [found[name] for name in sorted(found)]


@dataclass
class Message(WriterCommitMessage):
    files: list[str]


class UnitWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.unit, self.signature, self.schema = options["path"], options.get("unit"), options.get("signature"), schema.json()
        self.signed, self.order, self.shard, self.run = options.get("signed"), options.get("order"), int(options.get("shard", 1 << 20)), uuid.uuid4().hex

    def runs(self, table: pa.Table) -> tuple[pa.Table, list[int], list[int]]:
        """Rows with each unit's beside one another, and where a unit's begin and end."""
        if not self.unit:
            return table, [0], [table.num_rows]
        code = pc.dictionary_encode(table[self.unit].combine_chunks()).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        if (np.diff(code) < 0).any():
            order = np.argsort(code, kind="stable")
            table, code = table.take(pa.array(order)), code[order]
        starts = np.flatnonzero(np.append(True, np.diff(code) != 0)).tolist()
        return table, starts, [*starts[1:], table.num_rows]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Message:
        store, root = opened(self.path)
        writer: pq.ParquetWriter | None = None
        file, notes, held, done = "", [], 0, []

        def ended() -> None:
            nonlocal writer, notes, held
            writer.close()
            with store.open_input_stream(f"{root}/{ROWS}/{file}") as given:
                digest = hashlib.sha256()
                while data := given.read(1 << 24):
                    digest.update(data)
            publish(store, f"{root}/{ROWS}/{file}.json", json.dumps([n | {"sha256": digest.hexdigest()} for n in notes], default=str).encode())
            done.append(file)
            writer, notes, held = None, [], 0

        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                table, starts, ends = self.runs(pa.Table.from_batches([batch]))
                first_rows = pa.array(starts)
                named = table[self.unit].take(first_rows).to_pylist() if self.unit else [None]
                signatures = table[self.signed].take(first_rows).to_pylist() if self.signed else [self.signature] * len(starts)
                run, at = 0, 0
                while at < table.num_rows:
                    if writer is None:
                        store.create_dir(f"{root}/{ROWS}")
                        file = f"{self.run}-{uuid.uuid4().hex}.parquet"
                        writer = pq.ParquetWriter(f"{root}/{ROWS}/{file}", table.schema, filesystem=store)
                    until = min(table.num_rows, at + self.shard - held)
                    writer.write_table(table.slice(at, until - at))
                    while at < until:
                        end = min(ends[run], until)
                        low = high = None
                        if self.order:
                            low, high = pc.min_max(table[self.order].slice(at, end - at)).as_py().values()
                        name = name_of(named[run])
                        if notes and notes[-1]["name"] == name and notes[-1]["signature"] == signatures[run]:
                            note = notes[-1]
                            note["rows"] += end - at
                            note["first"], note["last"] = (f([x for x in (note[k], v) if x is not None], default=None) for f, k, v in ((min, "first", low), (max, "last", high)))
                        else:
                            notes.append({"unit": named[run], "name": name, "signature": signatures[run], "file": file, "at": held, "rows": end - at, "first": low, "last": high})
                        held += end - at
                        at = end
                        run += end == ends[run]
                    if held >= self.shard:
                        ended()
            if writer is not None:
                ended()
        except BaseException:
            if writer is not None:
                writer.close()
                store.delete_file(f"{root}/{ROWS}/{file}")
            self.removed(done)
            raise
        return Message(done)

    def removed(self, files: list[str]) -> None:
        store, root = opened(self.path)
        for p in [p for x in files for p in (f"{root}/{ROWS}/{x}", f"{root}/{ROWS}/{x}.json")]:
            if store.get_file_info(p).type == fs.FileType.File:
                store.delete_file(p)

    def commit(self, messages: list[Message | None]) -> None:
        store, root = opened(self.path)
        given = {"schema": self.schema, "files": sorted(f for m in messages for f in (m.files if m else []))}
        if not given["files"]:
            return
        known = noted(store, root, given)
        before = lists(store, root)
        place = max([time.time_ns(), *(int(x["path"].rsplit("/", 1)[1].split("-")[0]) + 1 for x in before)])
        store.create_dir(f"{root}/{LISTS}")
        publish(store, f"{root}/{LISTS}/{place:020d}-{self.run}.json", (json.dumps(given, indent=2) + "\n").encode())
        later = set(known)
        for x in reversed(before):
            names = set(noted(store, root, x))
            if names <= later:
                store.delete_file(x["path"])
                self.removed(x["files"])
            later |= names

    def abort(self, messages: list[Message | None]) -> None:
        for m in messages:
            self.removed(m.files if m else [])


@dataclass
class Piece(InputPartition):
    path: str
    ranges: list[tuple[int, int]]

    def __init__(self, path: str, ranges: list[tuple[int, int]]):
        super().__init__(path)
        self.path, self.ranges = path, ranges


class UnitReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], schema.names
        self.signature, self.first, self.last, self.units = options.get("signature"), options.get("first"), options.get("last"), options.get("units")

    def partitions(self) -> list[Piece]:
        found = marks(self.path)
        if not found:
            raise ValueError(f"{self.path} is unfinished: no unit is published")
        if self.units is not None and len(found) < int(self.units):
            raise ValueError(f"{self.path} is unfinished: {len(found)} of {self.units} units are published")
        foreign = [m["unit"] for m in found if self.signature is not None and m["signature"] != self.signature]
        if foreign:
            raise ValueError(f"{self.path} was made from another index: {foreign[:5]}")
        store, _ = opened(self.path)
        files = [(f"{m['folder']}/{f['file']}", f) for m in found for f in m["files"]]
        paths = sorted({p for p, _ in files})
        missing = [f.path for f in store.get_file_info(paths) if f.type != fs.FileType.File]
        if missing:
            raise ValueError(f"{self.path} lacks files that its marks name: {missing[:5]}")
        # rows without a known range are always read
        low, high = (None if x is None else float(x) for x in (self.first, self.last))
        ranges: dict[str, list[tuple[int, int]]] = {}
        for p, f in sorted(files, key=lambda x: (x[0], x[1]["at"])):
            if (low is None or f["last"] is None or f["last"] >= low) and (high is None or f["first"] is None or f["first"] <= high):
                own = ranges.setdefault(p, [])
                start = own.pop()[0] if own and own[-1][1] == f["at"] else f["at"]
                own.append((start, f["at"] + f["rows"]))
        return [Piece(p, own) for p, own in ranges.items()]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        starts, ends = np.array(partition.ranges).T
        at = 0
        file = pq.ParquetFile(partition.path, filesystem=store)
        for group in range(file.num_row_groups):
            n = file.metadata.row_group(group).num_rows
            if np.searchsorted(starts, at + n) > np.searchsorted(ends, at, side="right"):
                for batch in file.iter_batches(row_groups=[group], columns=self.names):
                    rows = np.arange(at, at + batch.num_rows)
                    inside = np.searchsorted(starts, rows, side="right") > np.searchsorted(ends, rows, side="right")
                    at += batch.num_rows
                    yield batch.select(self.names).filter(pa.array(inside))
            else:
                at += n


class Units(DataSource):
    @classmethod
    def name(cls) -> str:
        return "units"

    def schema(self) -> StructType:
        """That of the last commit; without one, the folder is unfinished."""
        for x in reversed(lists(*opened(self.options["path"]))):
            return StructType.fromJson(json.loads(x["schema"]))
        raise ValueError(f"{self.options['path']} is unfinished: no unit is published")

    def reader(self, schema: StructType) -> UnitReader:
        return UnitReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> UnitWriter:
        return UnitWriter(self.options, schema)


def write_units(rows: DataFrame, path: str, unit: str | None, signature: str | None = None, signed: str | None = None, order: str | None = None, shard: int = 1 << 20) -> None:
    """Replace each unit (the values of a column; None: the table is one) that ``rows`` has.

    The signature is given, or that of a column (``signed``).  With ``order``, files are ranges of
    that column of at most ``shard`` rows.
    """
    rows.sparkSession.dataSource.register(Units)
    if order:
        rows = rows.repartitionByRange(order).sortWithinPartitions(order)
    elif unit:
        # few places of a unit; a large unit is still cut, a task for each part
        rows = rows.hint("rebalance", unit).sortWithinPartitions(unit)
    given = {"path": path, "unit": unit, "signature": signature, "signed": signed, "order": order, "shard": shard}
    rows.write.format("units").mode("append").options(**{k: v for k, v in given.items() if v is not None}).save()


def read_units(spark: SparkSession, path: str, signature: str | None = None, units: int | None = None, first: float | None = None, last: float | None = None) -> DataFrame:
    """All units, guarded; of files with an order column, those within a range of it (their other rows too)."""
    spark.dataSource.register(Units)
    given = {"path": path, "signature": signature, "units": units, "first": first, "last": last}
    return spark.read.format("units").options(**{k: v for k, v in given.items() if v is not None}).load()


def published(spark: SparkSession, path: str) -> DataFrame:
    """unit, signature, rows of what is there: what a run has done already."""
    rows = [(None if m["unit"] is None else str(m["unit"]), m["signature"], sum(f["rows"] for f in m["files"])) for m in marks(path)]
    return spark.createDataFrame(rows, "unit string, signature string, rows long")
