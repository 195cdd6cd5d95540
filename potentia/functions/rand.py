"""Portable, partition-independent pseudo-random columns.

``F.rand(seed)`` depends on partitioning, so results change with cluster size. These
draw from ``md5(key ':' seed)`` instead: the same bits on any number of executors and in
DuckDB (the oracle uses the identical expression).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_52 = 4503599627370496.0  # 2^52: 13 hex digits of md5 -> [0, 1)


def uniform(key: Column | str, seed: int | str) -> Column:
    """u in [0, 1) from the first 52 bits of md5(key:seed)."""
    key = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(_TWO_52)


def uniform_open(key: Column | str, seed: int | str) -> Column:
    """u in (0, 1]: safe under ln()."""
    return F.lit(1.0) - uniform(key, seed)


def normal(key: Column | str, seed: int | str) -> Column:
    """Standard normal by Box-Muller from two independent uniforms."""
    u1 = uniform_open(key, f"{seed}:a")
    u2 = uniform(key, f"{seed}:b")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def sql_uniform(key_sql: str, seed: int | str) -> str:
    """DuckDB twin of :func:`uniform` for oracles."""
    return (f"(('0x' || substr(md5(CAST({key_sql} AS VARCHAR) || ':{seed}'), 1, 13))"
            f"::BIGINT::DOUBLE / {_TWO_52})")


def sql_uniform_open(key_sql: str, seed: int | str) -> str:
    return f"(1.0 - {sql_uniform(key_sql, seed)})"


def sql_normal(key_sql: str, seed: int | str) -> str:
    return (f"(sqrt(-2.0 * ln({sql_uniform_open(key_sql, f'{seed}:a')})) * "
            f"cos({2.0 * math.pi!r} * {sql_uniform(key_sql, f'{seed}:b')}))")


def sql_uniform_expr(key_sql: str, seed_sql: str) -> str:
    """Like :func:`sql_uniform` with the seed given as a SQL string expression."""
    return (f"(('0x' || substr(md5(CAST({key_sql} AS VARCHAR) || ':' || {seed_sql}), 1, 13))"
            f"::BIGINT::DOUBLE / {_TWO_52})")
