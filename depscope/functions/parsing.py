"""Values in texts: durations, memory sizes, typed metric values, row lists. As Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of durations in seconds and of memory in bytes (fixed values).
SECONDS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}
BYTES = {"kb": 1024.0, "mb": 1024.0**2, "gb": 1024.0**3}


def _amount(text: Column, units: dict[str, float]) -> Column:
    """The positive number before one of the units, times that unit; null for anything else."""
    pattern = rf"(?i)^\s*(\d+(?:\.\d+)?)\s*({'|'.join(units)})\s*$"
    number = F.regexp_extract(text, pattern, 1).try_cast("double")
    factor = F.element_at(F.create_map(*[F.lit(x) for u in units.items() for x in u]), F.lower(F.regexp_extract(text, pattern, 2)))
    return F.when(number > 0, number * factor)


def duration_seconds(text: Column) -> Column:
    """Seconds of ``50ms``, ``10s``, ``5m``, ``12h``; null for anything else and for zero."""
    return _amount(text, SECONDS)


def memory_bytes(text: Column) -> Column:
    """Bytes of ``512MB`` and the like (steps of 1024); null for anything else and for zero."""
    return _amount(text, BYTES).cast("long")


def value_kind(text: Column) -> Column:
    """bool, int, float or string: the first of these that the trimmed text reads as."""
    t = F.trim(text)
    return (
        F.when(F.lower(t).isin("true", "false"), "bool")
        .when(t.rlike(r"^[+-]?[0-9]+$"), "int")
        .when(F.lower(t).rlike(r"^[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"), "float")
        .otherwise("string")
    )


def row_list(text: Column) -> Column:
    """Row numbers of a text such as ``[3, 17]`` or ``3,17``; an empty one gives an empty array."""
    plain = F.translate(F.coalesce(text, F.lit("")), "[] ", "")
    return F.filter(F.transform(F.split(plain, ","), lambda x: x.try_cast("long")), lambda x: x.isNotNull())


def slug(text: Column) -> Column:
    """Lower-case letters and digits, with single hyphens between them; ``run`` if nothing is left."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    plain = F.regexp_replace(plain, "^-+|-+$", "")
    return F.when(plain == "", "run").otherwise(plain)
