"""Sums over tiles of image regions that are kept in pixel blocks, by summed-area tables.

A region's pixels lie in blocks of ``SIDE`` x ``SIDE``.  Each block becomes its part of the
region's summed-area table: sums of the block itself, of the columns above it, of the rows
to its left, and of all blocks above and to the left, by running sums over blocks.  The
sum over a tile of any size is then four look-ups.  No task holds a region.

Pixels outside a region count as 0, so a tile that sticks out has the sum of what lies
inside.  Pixels that no row states are 0, repeated ones add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import written

SIDE = 64


def blocks(pixels: DataFrame, side: int = SIDE) -> DataFrame:
    """key, by, bx, cells (side * side whole numbers by rows) of pixels (key, x, y, value)."""
    x, y = F.col("x"), F.col("y")
    one = pixels.where((x >= 0) & (y >= 0)).select("key", F.floor(y / side).cast("int").alias("by"), F.floor(x / side).cast("int").alias("bx"), (y % side * side + x % side).cast("int").alias("at"), F.col("value").cast("long").alias("value"))
    cells = one.groupBy("key", "by", "bx", "at").agg(F.sum("value").alias("value")).groupBy("key", "by", "bx").agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("m"))

    kind = dict(cells.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, side * side), np.int64)
            m = batch.column(3)
            row = np.repeat(np.arange(batch.num_rows), np.diff(m.offsets.to_numpy()))
            first, last = (m.offsets[0].as_py(), m.offsets[-1].as_py()) if batch.num_rows else (0, 0)
            out[row, m.keys.to_numpy()[first:last]] = m.items.to_numpy()[first:last]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * side * side), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["key", "by", "bx", "cells"])

    return cells.mapInArrow(run, f"key {kind}, by int, bx int, cells array<long>")


def summed_area(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """key, by, bx, sums: of the pixels above and left of each, itself included, over the whole region.

    A block that a region lacks within its width and height is 0 and is filled in.
    """
    cells = written(cells, "blocks")
    ends = cells.groupBy("key").agg(F.max("by").alias("h"), F.max("bx").alias("w"))
    every = ends.select("key", F.explode(F.sequence(F.lit(0), F.col("h"))).alias("by"), "w").select("key", "by", F.explode(F.sequence(F.lit(0), F.col("w"))).alias("bx"))
    whole = every.join(cells, ["key", "by", "bx"], "left").withColumn("cells", F.coalesce("cells", F.array_repeat(F.lit(0).cast("long"), side * side)))
    kind = dict(cells.dtypes)["key"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).flatten().to_numpy().reshape(-1, side, side)
            n = len(x)
            lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (a.size // max(n, 1))), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists(x.cumsum(1).cumsum(2)), lists(x.sum(1)), lists(x.sum(2)), pa.array(x.sum((1, 2)))], names=["key", "by", "bx", "own", "columns", "rows", "total"])

    parts = written(whole.select("key", "by", "bx", "cells").mapInArrow(local, f"key {kind}, by int, bx int, own array<long>, columns array<long>, rows array<long>, total long"), "block-sums")

    def running(of: str, along: str, across: str, name: str) -> DataFrame:
        """Running sums, before each block, of its vectors."""
        each = parts.select("key", "by", "bx", F.posexplode(of).alias("at", "s"))
        before = F.coalesce(F.sum("s").over(W.partitionBy("key", across, "at").orderBy(along).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return each.withColumn("s", before).groupBy("key", "by", "bx").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias(name))

    left_total = F.coalesce(F.sum("total").over(W.partitionBy("key", "by").orderBy("bx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    corners = parts.select("key", "by", "bx", left_total.alias("t"))
    corners = corners.select("key", "by", "bx", F.coalesce(F.sum("t").over(W.partitionBy("key", "bx").orderBy("by").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("corner"))
    on = ["key", "by", "bx"]
    joined = parts.select(*on, "own").join(running("columns", "by", "bx", "above"), on).join(running("rows", "bx", "by", "left"), on).join(corners, on)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, above, left = (batch.column(k).flatten().to_numpy() for k in (3, 4, 5))
            s = own.reshape(-1, side, side) + above.reshape(-1, 1, side).cumsum(2) + left.reshape(-1, side, 1).cumsum(1) + batch.column(6).to_numpy()[:, None, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * side * side), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["key", "by", "bx", "sums"])

    return joined.select(*on, "own", "above", "left", "corner").mapInArrow(add, f"key {kind}, by int, bx int, sums array<long>")


def tile_sums(tables: DataFrame, tiles: DataFrame, tile: int, side: int = SIDE) -> DataFrame:
    """``tiles`` (key, w, h, x, y) with total: the sum over each tile's cells within its region."""
    within = lambda at, end: F.least(F.greatest(at, F.lit(0)), end)

    def corner(x: Column, y: Column, sign: int) -> Column:
        return F.struct((within(x, F.col("w")) - 1).alias("cx"), (within(y, F.col("h")) - 1).alias("cy"), F.lit(sign).alias("sign"))

    x, y = F.col("x"), F.col("y")
    ends = F.array(corner(x, y, 1), corner(x + tile, y, -1), corner(x, y + tile, -1), corner(x + tile, y + tile, 1))
    asked = tiles.select("key", "x", "y", F.explode(ends).alias("c")).where("c.cx >= 0 and c.cy >= 0")
    asked = asked.select("key", "x", "y", "c.sign", F.floor(F.col("c.cy") / side).cast("int").alias("by"), F.floor(F.col("c.cx") / side).cast("int").alias("bx"), (F.col("c.cy") % side * side + F.col("c.cx") % side).cast("int").alias("at"))
    found = asked.join(tables, ["key", "by", "bx"]).select("key", "x", "y", (F.col("sign") * F.get("sums", F.col("at"))).alias("s"))
    sums = found.groupBy("key", "x", "y").agg(F.sum("s").alias("total"))
    return tiles.join(sums, ["key", "x", "y"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))


def tissue_fractions(pixels: DataFrame, tiles: DataFrame, tile: int, side: int = SIDE) -> DataFrame:
    """``tiles`` with tissue_frac: the share of a tile's area that is tissue; pixels: key, x, y, value (1: tissue)."""
    found = tile_sums(summed_area(blocks(pixels, side), side), tiles, tile, side)
    return found.withColumn("tissue_frac", F.col("total") / float(tile * tile)).drop("total")
