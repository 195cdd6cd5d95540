"""Vector column expressions (all JVM-side, no Python per row).

Vectors are ``ARRAY<DOUBLE>`` columns. Every helper takes and returns ``Column``s so
Catalyst can fold, prune and push around them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_array(c: ColumnOrName) -> Column:
    """FLOAT/INT arrays -> DOUBLE arrays (all maths is done in double)."""
    return F.transform(_c(c), lambda v: v.cast("double"))


def _sum(arr: Column) -> Column:
    # Sequential left fold: same summation order as DuckDB's list_sum and as our numpy kernels.
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda s, z: s + z)


def sq_dist(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(_c(a), _c(b), lambda p, q: (p - q) * (p - q)))


def euclidean(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Euclidean distance (P5)."""
    return F.sqrt(sq_dist(a, b))


def manhattan(a: ColumnOrName, b: ColumnOrName) -> Column:
    """L1 distance."""
    return _sum(F.zip_with(_c(a), _c(b), lambda p, q: F.abs(p - q)))


def chebyshev(a: ColumnOrName, b: ColumnOrName) -> Column:
    """L-infinity distance."""
    return F.array_max(F.zip_with(_c(a), _c(b), lambda p, q: F.abs(p - q)))


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda p, q: p * q))


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda v: v * v)))


def cosine_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    """1 - cos(a, b) (P8); NULL when either vector has zero norm."""
    den = norm(a) * norm(b)
    return F.when(den > 0, F.lit(1.0) - dot(a, b) / den)


def l2_normalize(a: ColumnOrName) -> Column:
    """Row L2 normalisation (P1); zero vectors become NULL."""
    n = norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda v: v / n))


def scale(a: ColumnOrName, factor: float) -> Column:
    """Multiply every coordinate (P2: factor = 1/255)."""
    return F.transform(_c(a), lambda v: v * F.lit(float(factor)))


def gaussian_kernel(d2: ColumnOrName, c: float | Column) -> Column:
    """exp(-d2 / (2 c^2))."""
    c = F.lit(float(c)) if not isinstance(c, Column) else c
    return F.exp(-_c(d2) / (F.lit(2.0) * c * c))


def radial_kernel(d2: ColumnOrName, r: float | Column) -> Column:
    """1 inside radius r (inclusive), else 0 (P10)."""
    r = F.lit(float(r)) if not isinstance(r, Column) else r
    return F.when(_c(d2) <= r * r, F.lit(1.0)).otherwise(F.lit(0.0))


def accept_probability(d2: ColumnOrName, shift: float, z: float) -> Column:
    """clip((d2 - shift) / z, 0, 1)."""
    return F.least(F.greatest((_c(d2) - F.lit(float(shift))) / F.lit(float(z)), F.lit(0.0)),
                   F.lit(1.0))


def voltage_to_distance(v: ColumnOrName) -> Column:
    """-0.2 ln(v); NULL for v <= 0."""
    return F.when(_c(v) > 0, F.lit(-0.2) * F.log(_c(v)))


def coord(a: ColumnOrName, i: int) -> Column:
    """i-th coordinate (0-based), 0.0 when the vector is shorter."""
    return F.coalesce(F.get(_c(a), i), F.lit(0.0))


def in_box(a: ColumnOrName, lo: list[float], hi: list[float]) -> Column:
    """Inclusive axis-aligned box test."""
    lo_c = F.array(*[F.lit(float(v)) for v in lo])
    hi_c = F.array(*[F.lit(float(v)) for v in hi])
    return (F.forall(F.zip_with(_c(a), lo_c, lambda p, q: p >= q), lambda b: b)
            & F.forall(F.zip_with(_c(a), hi_c, lambda p, q: p <= q), lambda b: b)
            & (F.size(_c(a)) == len(lo)))


DISTANCES: dict[str, Callable[[ColumnOrName, ColumnOrName], Column]] = {
    "sqeuclidean": sq_dist,
    "euclidean": euclidean,
    "manhattan": manhattan,
    "chebyshev": chebyshev,
    "cosine": cosine_distance,
}


def distance(name_or_fn: str | Callable[[Column, Column], Column]) -> Callable:
    """User-pluggable distance (X1): a name or any ``(Column, Column) -> Column``."""
    if callable(name_or_fn):
        return name_or_fn
    if name_or_fn not in DISTANCES:
        raise ValueError(f"unknown distance {name_or_fn!r}; one of {sorted(DISTANCES)}")
    return DISTANCES[name_or_fn]


def rounded(c: Column | str, places: int) -> Column:
    """``F.round`` of doubles, the same value: it goes through decimal text, which costs more than making a pair. Scaled numbers
    below 2^40 that lie clear of a half are rounded as integers, and a quotient of two exact numbers is the nearest double."""
    c = F.col(c) if isinstance(c, str) else c
    scaled = c * F.lit(10.0 ** places)
    whole = F.floor(scaled)
    clear = (scaled >= F.lit(0.0)) & (scaled < F.lit(float(1 << 40))) & (F.abs(scaled - whole - F.lit(0.5)) > F.lit(1e-3))
    return F.when(clear, F.floor(scaled + F.lit(0.5)) / F.lit(10.0 ** places)).otherwise(F.round(c, places))
