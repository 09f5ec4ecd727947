"""Numbers and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ("kB", "MB", "GB", "TB", "PB", "EB")


def next_power_of_ten(n: Column) -> Column:
    """The least power of ten from n on; 10 for n up to 1."""
    digits = F.length(F.ceil(n).cast("long").cast("string"))
    power = F.pow(F.lit(10.0), digits - 1).cast("long")
    return F.when(n <= 1, F.lit(10).cast("long")).when(power >= n, power).otherwise(power * 10)


def in_units(count: Column, unit: str | None = None, base: int = 1024, last: str = _UNITS[-1]) -> tuple[Column, Column]:
    """(value, unit) of a number of bytes: in the unit given by its first letter, else in the first up to last in which it is less than base; in last if it is less in none."""
    sized = [(count / float(base) ** k, u) for k, u in enumerate(_UNITS, 1)]
    if unit is not None:
        return next((x, F.lit(u)) for x, u in sized if u[0].lower() == unit.lower())
    sized = sized[: _UNITS.index(last) + 1]
    value, name = sized[-1][0], F.lit(sized[-1][1])
    for x, u in reversed(sized[:-1]):
        value, name = F.when(x < base, x).otherwise(value), F.when(x < base, F.lit(u)).otherwise(name)
    return value, name


def is_volume(nx: Column, ny: Column, nz: Column) -> Column:
    """Whether a map of that many columns, rows and sections is a volume and not one section."""
    return (nx > 1) & (ny > 1) & (nz > 1)


def is_amyloid(twist: Column, rise: Column) -> Column:
    """Whether up to ten subunits together rise by 4.5 to 5, as the strands of a cross-beta fibril do."""
    hit = F.lit(False)
    for n in range(1, 11):
        hit = hit | ((rise * n > 4.5) & (rise * n < 5))
    return hit
