"""Station id -> region."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns per region. A pattern has to match at the start of the id, not the whole id.
REGION_PATTERNS = {
    "NYC": [
        r"(?:\d{1,3}|\d{4}\.\d\d)",
        r"S 5th St & Kent Ave",
        r"MTL-ECO51-1",
        r"MTL-ECO5-LAB",
        r"Shop Morgan",
    ],
    "JC": [r"JC\d{3}", r"Liberty State Park"],
    "HB": [r"HB\d{3}"],
    "SYS": [r"(?:SYSY?\d{3}|Lab - NYC)", r"JCSYS", r"X-MTL-AOS-5\.1"],
    "None": [r"None$"],
}
NO_STATION = "None"
#: Rides touching one of these at either end are not trips.
EXCLUDED_REGIONS = ["None", "SYS"]

# Fixed value: ids of the two New Jersey regions.
NJ_PREFIX = r"(?:JC|HB)"


def region_regex(*names: str) -> str:
    return "^(?:" + "|".join(p for n in names for p in REGION_PATTERNS[n]) + ")"


def _id(station_id: Column) -> Column:
    return F.coalesce(station_id, F.lit(NO_STATION))


def region_matches(station_id: Column) -> Column:
    """How many regions claim the id; more than one means the patterns overlap."""
    hits = [F.when(_id(station_id).rlike(region_regex(r)), 1).otherwise(0) for r in REGION_PATTERNS]
    total = hits[0]
    for hit in hits[1:]:
        total = total + hit
    return total


def region_of(station_id: Column, publisher: Column | str | None = None) -> Column:
    """Region of a station id; null if no pattern matches, ``'None'`` for a missing id.

    ``publisher`` is the region whose file the ride came from: an NYC-looking id in a JC file is in JC.
    The regions' patterns exclude one another (checked by ``quality.region_violations``), so first match wins.
    """
    region = F.lit(None).cast("string")
    for name in reversed(list(REGION_PATTERNS)):
        region = F.when(_id(station_id).rlike(region_regex(name)), name).otherwise(region)
    if publisher is not None:
        source = F.lit(publisher) if isinstance(publisher, str) else publisher
        region = F.when((region == "NYC") & (source == "JC"), "JC").otherwise(region)
    return region


def is_trip(start_station_id: Column, end_station_id: Column) -> Column:
    """False for rides that touch a system or missing station; unrecognised ids stay.

    Tests the ids, one pattern per end, so that it can run before the regions are worked out.
    """
    excluded = region_regex(*EXCLUDED_REGIONS)
    return ~_id(start_station_id).rlike(excluded) & ~_id(end_station_id).rlike(excluded)
