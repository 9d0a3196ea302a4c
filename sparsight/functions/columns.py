"""Scalar and array column functions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of a count and what they multiply by.
COUNT_SUFFIXES = {"k": 1_000, "m": 1_000_000}

# Fixed value: smallest norm used when a vector is scaled to unit length.
NORM_FLOOR = 1e-12


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_doubles(vec: Column | str) -> Column:
    return _col(vec).cast("array<double>")


def parse_count(text: Column | str) -> Column:
    """``"123"``, ``"196K"`` or ``"2m"`` as a BIGINT; anything else is an error."""
    text = _col(text)
    digits = F.regexp_extract(text, r"^([0-9]+|[+-]?[0-9]+(?=[kKmM]))[kKmM]?$", 1)
    suffix = F.lower(F.regexp_extract(text, r"([kKmM])$", 1))
    scale = F.lit(1)
    for name, factor in COUNT_SUFFIXES.items():
        scale = F.when(suffix == name, F.lit(factor)).otherwise(scale)
    problem = F.raise_error(F.concat(F.lit("not a count: "), F.coalesce(text, F.lit("NULL"))))
    return F.when(digits != "", digits.cast("bigint") * scale).otherwise(problem.cast("bigint"))


def shard_of(row_idx: Column | str, n: int) -> Column:
    return F.pmod(_col(row_idx), F.lit(n)).cast("int")


def offset_of(row_idx: Column | str, n: int) -> Column:
    return F.call_function("div", _col(row_idx), F.lit(n)).cast("bigint")


def row_of(shard: Column | str, offset: Column | str, n: int) -> Column:
    return (_col(offset) * F.lit(n) + _col(shard)).cast("bigint")


def in_worker_slice(row_idx: Column | str, n: int, workers: int, worker: int) -> Column:
    """True for rows whose shard (of ``n``) belongs to ``worker`` of ``workers``."""
    return F.pmod(F.pmod(_col(row_idx), F.lit(n)), F.lit(workers)) == worker


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product, summed left to right in double precision."""
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(vec: Column | str) -> Column:
    norm = F.greatest(F.sqrt(dot(vec, vec)), F.lit(NORM_FLOOR))
    return F.transform(as_doubles(vec), lambda x: x / norm)


def subtract(vec: Column | str, offset: list[float]) -> Column:
    """``vec`` minus a fixed vector."""
    return F.zip_with(as_doubles(vec), F.lit(list(offset)), lambda x, b: x - b)


def densify(features: Column | str, size: int) -> Column:
    """A feature map as a zero-filled array of ``size`` entries (small sizes only)."""
    features = _col(features)
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.coalesce(F.element_at(features, i), F.lit(0.0)),
    )
