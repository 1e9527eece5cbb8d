"""Calendar and duration expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

SECONDS_PER_DAY = 86_400


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def duration_seconds(start: ColumnOrName, stop: ColumnOrName, mode: str = "component") -> Column:
    """Whole seconds between two timestamps, as a long.

    ``component`` keeps only the time-of-day part of the interval, so a ride of 25 h counts 1 h and a
    ride that stops before it starts wraps to a positive value below 24 h. ``total`` is the plain difference.
    """
    if mode not in ("component", "total"):
        raise ValueError(f"duration mode must be 'component' or 'total', not {mode!r}")
    # Parts of the interval, all of one sign. Unlike a difference in a unit this never passes through the
    # session time zone, and it costs half as much.
    interval = _col(stop) - _col(start)
    part = {unit: F.extract(F.lit(unit), interval) for unit in ("DAY", "HOUR", "MINUTE", "SECOND")}
    in_day = (part["HOUR"] * 3600 + part["MINUTE"] * 60).cast("long") + F.floor(part["SECOND"]).cast("long")
    if mode == "component":
        return F.pmod(in_day, F.lit(SECONDS_PER_DAY).cast("long"))
    return part["DAY"].cast("long") * SECONDS_PER_DAY + in_day


def year_month(ts: ColumnOrName) -> Column:
    """``yyyyMM`` text of a timestamp.

    Put together from calendar parts: formatting would take a zone-less timestamp through the session time zone.
    """
    return F.concat(F.year(_col(ts)).cast("string"), F.lpad(F.month(_col(ts)).cast("string"), 2, "0"))


def year_month_int(ts: ColumnOrName) -> Column:
    """``yyyymm`` as an int, for partition columns."""
    return (F.year(_col(ts)) * 100 + F.month(_col(ts))).cast("int")


def month_label(year: ColumnOrName, month: ColumnOrName) -> Column:
    """``YYYY-MM`` text from a year and a month number."""
    return F.concat_ws("-", _col(year).cast("string"), F.lpad(_col(month).cast("string"), 2, "0"))


def month_label_of(ts: ColumnOrName) -> Column:
    """``YYYY-MM`` text of a timestamp."""
    return month_label(F.year(_col(ts)), F.month(_col(ts)))


def slice_label(start: ColumnOrName, stop: ColumnOrName) -> Column:
    """``yyyyMM_yyyyMM``: the slice a ride is stored under, by start and end month."""
    return F.concat_ws("_", year_month(start), year_month(stop))


def day_class(weekday: ColumnOrName) -> Column:
    """``Weekday`` or ``Weekend`` from a Monday-based weekday number."""
    return F.when(_col(weekday) < 5, "Weekday").otherwise("Weekend")


def duration_label(seconds: ColumnOrName) -> Column:
    """``1h2m3s`` text of a number of seconds; zero parts are left out, zero itself is ``0s``.

    Days are dropped, as in :func:`duration_seconds` with mode ``component``.
    """
    s = _col(seconds).cast("long")
    hours = F.pmod(F.floor(s / 3600), F.lit(24)).cast("long")
    minutes = F.pmod(F.floor(s / 60), F.lit(60)).cast("long")
    rest = F.pmod(s, F.lit(60)).cast("long")
    parts = [
        F.when(value > 0, F.concat(value.cast("string"), F.lit(unit))).otherwise("")
        for value, unit in ((hours, "h"), (minutes, "m"), (rest, "s"))
    ]
    text = F.concat(*parts)
    return F.when(s.isNull(), F.lit(None)).when(text == "", "0s").otherwise(text)
