"""Tile geometry of image regions, tissue fractions, and the tiles that are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import is_tissue, let

TILE = 224
TISSUE_MIN = 0.10


def resampled(side: Column, mpp: float = 0.25, target: float = 0.5) -> Column:
    """A side's length at the target resolution, rounded half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(side * (mpp / target), 0).cast("int"))


def axis(side: Column, tile: int = TILE) -> Column:
    """First cells of the tiles along a side: as many as fit, centred; one tile, sticking out on both ends, where none fits."""
    n = F.greatest(F.lit(1), F.floor(side / tile).cast("int"))
    start = F.floor((side - n * tile) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + i * tile)


def grid(regions: DataFrame, tile: int = TILE) -> DataFrame:
    """A row for each tile of each region (w, h): x, y."""
    rows = regions.withColumn("x", F.explode(axis(F.col("w"), tile)))
    return rows.withColumn("y", F.explode(axis(F.col("h"), tile)))


def inside(w: Column, h: Column, x: Column, y: Column, tile: int = TILE) -> Column:
    """Share of a tile's area within its region."""
    return area(w, h, x, y, tile) / float(tile * tile)


def area(w: Column, h: Column, x: Column, y: Column, tile: int = TILE) -> Column:
    """Cells of a tile within its region."""
    span = lambda at, side: F.greatest(F.lit(0), F.least(at + tile, side) - F.greatest(at, F.lit(0)))
    return span(x, w) * span(y, h)


def kept_tiles(tiles: DataFrame, key: str, fraction: str = "tissue_frac", least: float = TISSUE_MIN) -> DataFrame:
    """Tiles with enough tissue; of a region without one, its best tile (ties: first in raster order), marked as fallback."""
    best = tiles.groupBy(key).agg(F.min(F.struct((-F.col(fraction)).alias("f"), F.col("y").alias("y"), F.col("x").alias("x"))).alias("best"))
    joined = tiles.join(best, key)
    fallback = (-F.col("best.f") < least) & (F.col("best.y") == F.col("y")) & (F.col("best.x") == F.col("x"))
    return joined.where((F.col(fraction) >= least) | fallback).withColumn("fallback", fallback.cast("int")).drop("best")


def pixel_fractions(pixels: Column) -> Column:
    """Shares of tissue, black and white pixels of an array of r, g, b, to four decimals; the array is made once."""
    share = lambda p, test: F.round(F.try_divide(F.size(F.filter(p, test)).cast("double"), F.size(p)), 4)
    return let(pixels, lambda some: F.struct(
        share(some, lambda p: is_tissue(p["r"], p["g"], p["b"])).alias("tissue_frac"),
        share(some, lambda p: F.greatest(p["r"], p["g"], p["b"]) == 0).alias("black_frac"),
        share(some, lambda p: F.least(p["r"], p["g"], p["b"]) > 220).alias("white_frac"),
    ))


def usable(items: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Rows whose stored fraction, rounded to four decimals, reaches their dataset's threshold; datasets without one stay whole."""
    least = F.lit(None).cast("double")
    for dataset, value in thresholds.items():
        least = F.when(F.col("dataset") == dataset, F.lit(value)).otherwise(least)
    return items.where(least.isNull() | (F.round("tissue_frac", 4) >= least))
