"""Column expressions that the operators share: hash draws, vectors, rounding, display forms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_int(*parts: Column | str | int) -> Column:
    """First eight hexadecimal digits of the MD5 of the parts joined by colons, as a number: the same in any engine."""
    columns = [F.lit(str(p)) if not isinstance(p, Column) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns)), 1, 8), 16, 10).cast("long")


def hash_text(*parts: Column | str | int) -> Column:
    columns = [F.lit(str(p)) if not isinstance(p, Column) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *columns))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, though f may use it often (within other arrays' functions, too)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda p, q: p + q)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda p, q: p + q)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def rounded_each(values: Column, digits: int) -> Column:
    """Each value rounded half up; one below zero that rounds to nothing is a negative zero, as C and SQL have it."""
    return F.transform(values, lambda x: F.abs(F.round(x, digits)) * F.signum(x))


def unit_distance(similarity: Column) -> Column:
    """Distance of unit vectors from their cosine."""
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - F.lit(2.0) * similarity))


def argmax(values: Column) -> Column:
    """Position of the largest value, from 0, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(values: Column) -> Column:
    shares = lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t))
    return let(values, lambda v: let(F.array_max(v), lambda top: let(F.transform(v, lambda x: F.exp(x - top)), shares)))


def centred_unit(values: Column, floor: float = 1e-6) -> Column:
    """Centred and brought to unit length: inner products are then Pearson correlations."""
    scaled = lambda m: let(norm(m) + floor, lambda length: F.transform(m, lambda x: x / length))
    return let(values, lambda v: let(total(v) / F.size(v), lambda mean: let(F.transform(v, lambda x: x - mean), scaled)))


def root_normalised(values: Column, floor: float = 1e-7) -> Column:
    """Scaled to sum 1, then square roots."""
    return let(values, lambda v: let(total(v) + floor, lambda t: F.transform(v, lambda x: F.sqrt(F.greatest(F.lit(0.0), x) / t))))


def symmetries(side: int) -> list[list[int]]:
    """Positions of a square array's cells under its eight symmetries."""
    grid = [[r * side + c for c in range(side)] for r in range(side)]
    out = []
    for start in (grid, [row[::-1] for row in grid]):
        g = start
        for _ in range(4):
            out.append([x for row in g for x in row])
            g = [list(row) for row in zip(*g[::-1])]
    return out


def quantised(values: Column, bits: int) -> Column:
    """Symmetric quantisation to signed integers of ``bits`` bits and back."""
    top = float(2 ** (bits - 1) - 1)
    largest = lambda v: F.aggregate(v, F.lit(0.0), lambda p, q: F.greatest(p, F.abs(q.cast("double"))))
    rounded = lambda v, scale: F.transform(v, lambda x: F.when(scale > 0, F.bround(x.cast("double") / scale, 0) * scale).otherwise(F.lit(0.0)))
    return let(values, lambda v: let(largest(v) / top, lambda scale: rounded(v, scale)))


def floating(values: Column, digits: int, least: int, most: float) -> Column:
    """Rounded to floating-point numbers of ``digits`` significant bits (ties to even) with exponents from ``least`` up; beyond ``most`` infinite."""

    def one(x: Column) -> Column:
        x = x.cast("double")
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))).cast("double"), F.lit(float(least))) - (digits - 1))
        near = F.bround(x / step, 0) * step
        return F.when(x == 0, F.lit(0.0)).when(F.abs(near) > most, F.signum(x) * float("inf")).otherwise(near)

    return F.transform(values, one)


def is_tissue(r: Column, g: Column, b: Column) -> Column:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return (top - low > 15) & (top > 30)


def shown(value: Column, digits: int = 4) -> Column:
    """Fixed decimals of the exact binary value; values that aren't finite as two dashes."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.translate(F.format_number(value, digits), ",", "")).otherwise("--")


def shown_sd(value: Column) -> Column:
    return F.when((value > 0) & (value < 0.0001), "<0.0001").otherwise(shown(value))


def shown_p(value: Column) -> Column:
    return F.when(value < 0.001, "<0.001").otherwise(shown(value, 3))


def chi2_tail(statistic: float, freedom: int) -> float:
    """P(chi-square > statistic): regularised upper incomplete gamma, by series or continued fraction."""
    if statistic <= 0:
        return 1.0
    a, x = freedom / 2, statistic / 2
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - scale * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b or 1e-300)
        c = b + n / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h
