"""Robust verification of pairs by their matched points.

A pair's matches are points (x, y) of one side and (u, v) of the other.  Hypotheses are
similarity transforms (turn, scale, shift) through two matches that hashes of the pair
pick; the matches that a transform maps to within ``TOLERANCE`` are its inliers.  The
transform of most inliers wins, the first of equal ones; a pair with ``LEAST`` or more is
verified.  A pair is one row of arrays, so batches of pairs go through a task together.

Points are complex numbers here: a similarity transform is z -> s z + t.  Two matches
at one place give no transform.  Null coordinates are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE, LEAST, HYPOTHESES = 3.0, 15, 128


def picks(a: int, b: int, matches: int, hypotheses: int) -> np.ndarray:
    """Two matches for each hypothesis."""
    draw = lambda h, side: int(hashlib.md5(f"{a}:{b}:{h}:{side}".encode()).hexdigest()[:8], 16) % matches
    return np.array([[draw(h, 0), draw(h, 1)] for h in range(hypotheses)], np.int64)


def consensus(p: np.ndarray, q: np.ndarray, pick: np.ndarray, tolerance: float) -> tuple[int, complex, complex]:
    """Inliers, s and t of the best transform."""
    away = p[pick[:, 1]] - p[pick[:, 0]]
    some = np.flatnonzero(away != 0)
    if not len(some):
        return 0, 0j, 0j
    s = (q[pick[some, 1]] - q[pick[some, 0]]) / away[some]
    t = q[pick[some, 0]] - s * p[pick[some, 0]]
    counts = (np.abs(s[:, None] * p + t[:, None] - q) <= tolerance).sum(1)
    best = int(np.argmax(counts))
    return int(counts[best]), complex(s[best]), complex(t[best])


def verified(matches: DataFrame, tolerance: float = TOLERANCE, least: int = LEAST, hypotheses: int = HYPOTHESES) -> DataFrame:
    """a, b, matches, inliers, kept, and scale, turn (radians), dx, dy of the transform of kept pairs.

    matches: a, b, k (order within the pair), x, y, u, v.
    """
    names = ("x", "y", "u", "v")
    points = F.array_sort(F.collect_list(F.struct("k", *(F.col(c).cast("double").alias(c) for c in names))))
    whole = matches.where(" and ".join(f"{c} is not null" for c in names)).groupBy("a", "b").agg(points.alias("points"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("matches", pa.int64()), ("inliers", pa.int64()), ("kept", pa.bool_()), *((c, pa.float64()) for c in ("scale", "turn", "dx", "dy"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                x, y, u, v = (batch.column(2)[i].values.field(c).to_numpy() for c in names)
                n, s, t = consensus(x + 1j * y, u + 1j * v, picks(a, b, len(x), hypotheses), tolerance)
                found = (abs(s), float(np.angle(s)), t.real, t.imag) if n >= least else (None,) * 4
                out.append((a, b, len(x), n, n >= least, *found))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    given = whole.select(F.col("a").cast("long"), F.col("b").cast("long"), F.transform("points", lambda p: F.struct(*(p[c].alias(c) for c in names))).alias("points"))
    return given.mapInArrow(run, "a long, b long, matches long, inliers long, kept boolean, scale double, turn double, dx double, dy double")
