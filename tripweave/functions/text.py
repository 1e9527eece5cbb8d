"""Pattern filters and extracts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripweave.functions.regions import NJ_PREFIX


def starts_with_pattern(c: Column, pattern: str = NJ_PREFIX, negate: bool = False) -> Column:
    """Does ``c`` match ``pattern`` at its start; a null never does."""
    hit = F.coalesce(c.rlike("^" + pattern), F.lit(False))
    return ~hit if negate else hit


def all_known(columns: Sequence[str]) -> Column:
    """No column is null. Written out per column, as a scan can evaluate it that way."""
    known = [F.col(c).isNotNull() for c in columns]
    return reduce(lambda a, b: a & b, known) if known else F.lit(True)


def include_exclude(c: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Keep values matching any ``include`` pattern, or none of the ``exclude`` patterns, not both."""
    if include and exclude:
        raise ValueError("give include or exclude patterns, not both")
    patterns = list(include or exclude)
    if not patterns:
        return F.lit(True)
    hit = F.coalesce(c.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))
    return hit if include else ~hit


def not_equal_or_null(c: Column, value) -> Column:
    """``c != value`` where a null counts as different."""
    return ~c.eqNullSafe(F.lit(value))


def path_month(path: Column, group: str = "ym") -> Column:
    """``yyyy``, ``mm`` or ``yyyymm`` of a monthly file path; empty if the path has no month."""
    pattern = r"(?:^|/)(?:JC-)?(\d{4})(\d{2})[^/]*$"
    year = F.regexp_extract(path, pattern, 1)
    month = F.regexp_extract(path, pattern, 2)
    return {"y": year, "m": month, "ym": F.concat(year, month)}[group]


def id_prefix(station_id: Column) -> Column:
    """Letter prefix of a New Jersey station id (``JC`` or ``HB``), else empty."""
    return F.regexp_extract(station_id, r"^(JC|HB)\d+", 1)
