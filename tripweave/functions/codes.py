"""Code tables: enum domains, label maps and their expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered domains; anything outside becomes null.
RIDEABLE_TYPES = ["unknown", "classic_bike", "electric_bike"]
USER_TYPES = ["Subscriber", "Customer"]

# Code maps applied while normalising.
GENDER_CODES = {"U": 0, "M": 1, "F": 2}
MEMBER_CASUAL = {"member": "Subscriber", "casual": "Customer"}
DOCKED, CLASSIC = "docked_bike", "classic_bike"

# Display labels.
REGION_DISPLAY = {"HB": "HOB"}
USER_TYPE_DISPLAY = {"Customer": "Daily", "Subscriber": "Annual"}
GENDER_DISPLAY = {0: "Unknown", 1: "Men", 2: "Women"}
GENDER_LETTERS = {0: "U", 1: "M", 2: "F"}
RIDEABLE_DISPLAY = {
    "docked_bike": "Classic",
    "classic_bike": "Classic",
    "electric_bike": "Electric",
    "unknown": "Unknown",
    "motivate_dockless_bike": "Unknown",
}

# Dictionaries of the short-coded cube; a code is the position in the list.
SHORT_CODES = {
    "region": ["NYC", "JC", "HOB"],
    "user_type": ["Annual", "Daily"],
    "rideable_type": ["classic_bike", "docked_bike", "electric_bike", "unknown"],
}
SHORT_NAMES = {
    "region": "r",
    "year": "y",
    "month": "m",
    "gender": "g",
    "user_type": "t",
    "rideable_type": "b",
    "count": "c",
    "duration": "d",
}

# Order of the series in a stacked chart.
STACK_ORDER = {
    "user_type": ["Daily", "Annual"],
    "gender": ["Unknown", "Women", "Men"],
    "rideable_type": ["Electric", "Classic", "Unknown"],
    "region": ["JC", "HOB", "NYC"],
}


def lookup(c: Column, table: Mapping, default: Column | None = None) -> Column:
    """Value of ``c`` in ``table``; ``default`` (null if not given) for anything else."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    found = F.when(c.isNotNull(), F.try_element_at(literal, c))
    return found if default is None else F.coalesce(found, default)


def strict_lookup(c: Column, table: Mapping, what: str) -> Column:
    """Like :func:`lookup`, but an unknown value fails the query."""
    message = F.concat(F.lit(f"unknown {what}: "), F.coalesce(c.cast("string"), F.lit("null")))
    return F.coalesce(lookup(c, table), F.raise_error(message))


def replace_values(c: Column, table: Mapping) -> Column:
    """Replace the listed values and keep all others."""
    return lookup(c, table, default=c)


def closed_domain(c: Column, values: Sequence[str]) -> Column:
    """Null for anything outside ``values``."""
    return F.when(c.isin(list(values)), c)


def domain_rank(c: Column, values: Sequence[str]) -> Column:
    """Position of ``c`` in an ordered domain, for sorting; null if not in it."""
    rank = F.array_position(F.array(*[F.lit(v) for v in values]), c)
    return F.when(rank > 0, rank - 1)


def rideable_type(c: Column) -> Column:
    """Docked bikes are classic bikes; out-of-domain types are null."""
    return closed_domain(F.when(c == DOCKED, CLASSIC).otherwise(c), RIDEABLE_TYPES)


def member_casual(c: Column) -> Column:
    return lookup(c, MEMBER_CASUAL)


def gender_code(c: Column) -> Column:
    """``U/M/F`` or a number, given as text, to 0/1/2."""
    return F.coalesce(lookup(c, GENDER_CODES), c.try_cast("double").cast("int"))


def station_id(c: Column) -> Column:
    """Undo a float round trip of a whole-number id: ``72.0`` is ``72``. The pattern runs on the few ids that need it."""
    return F.when(c.endswith(".0"), F.regexp_replace(c, r"^(\d+)\.0$", "$1")).otherwise(c)


def whole_number(c: Column) -> Column:
    """Integer from text that may carry a ``.0`` suffix; null if it is not a number."""
    return station_id(c.cast("string")).try_cast("int")
