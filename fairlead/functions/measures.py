"""Arithmetic over paired outbound/inbound measures."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECTIONS = ("outbound", "inbound")

# Passenger-car equivalents per vehicle class.
PCE_WEIGHTS = {"cars": 1.0, "trucks": 2.5, "trucks_with_trailer": 4.5, "buses": 9.0, "other_large": 9.0}
# The vehicle classes of the wide and of the narrow vehicle total.
ALL_CLASSES = ("cars", "trucks", "trucks_with_trailer", "motorcycles", "buses")
ROAD_CLASSES = ("cars", "trucks", "trucks_with_trailer")
# Unit factors.
KMH_PER_KNOT = 1.852
MPH_PER_KNOT = 1.15078
METRES_PER_NM = 1852.0
KG_CO2_PER_LITRE = 2.68


def directional(base: str, direction: str) -> str:
    """Column name of a measure; ``{}`` in the base marks an inner direction."""
    return base.format(direction) if "{}" in base else f"{base}_{direction}"


def both(base: str, nulls: str = "zero") -> Column:
    """Outbound plus inbound: nulls count as zero, or make the sum null."""
    out, back = (F.col(directional(base, d)) for d in DIRECTIONS)
    if nulls == "zero":
        return F.coalesce(out, F.lit(0.0)) + F.coalesce(back, F.lit(0.0))
    if nulls == "propagate":
        return out + back
    raise ValueError(f"nulls must be 'zero' or 'propagate', not {nulls!r}")


def mean_of_both(base: str) -> Column:
    return both(base, "propagate") / 2


def vehicles(classes=ALL_CLASSES, directions=DIRECTIONS) -> Column:
    """Zero-filled vehicle total over classes and directions."""
    return reduce(add, [F.coalesce(F.col(f"{c}_{d}"), F.lit(0)) for d in directions for c in classes])


def pce(direction: str, available) -> Column:
    """Passenger-car equivalent from the class counts that the frame has."""
    terms = [
        F.coalesce(F.col(f"{name}_{direction}"), F.lit(0)) * F.lit(weight)
        for name, weight in PCE_WEIGHTS.items() if f"{name}_{direction}" in available
    ]
    return reduce(add, terms)


def with_pce(df: DataFrame) -> DataFrame:
    return df.withColumns({f"pce_{d}": pce(d, df.columns) for d in DIRECTIONS})


def pce_mismatch(df: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose recorded equivalent differs from the one of their counts."""
    wrong = reduce(
        lambda a, b: a | b,
        [F.abs(F.col(f"pce_{d}") - F.coalesce(F.col(f"passenger_car_equivalent_{d}"), F.lit(0.0))) > tolerance
         for d in DIRECTIONS],
    )
    return with_pce(df).filter(wrong)


def complete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows in which every listed column is present."""
    return df.dropna(subset=cols)


def moving(df: DataFrame, sog: str, threshold: float = 1.0) -> DataFrame:
    """Drop points strictly below the speed threshold."""
    return df.filter(F.col(sog) >= threshold)


def to_kmh(knots: Column) -> Column:
    return knots * KMH_PER_KNOT


def to_mph(knots: Column) -> Column:
    return knots * MPH_PER_KNOT


def to_tonnes(kg: Column) -> Column:
    return kg / 1000


def to_nm(metres: Column) -> Column:
    return metres / METRES_PER_NM


def ratio(num: Column, den: Column, on_zero: str = "null") -> Column:
    """Division whose zero denominator gives null or infinity; a null side gives null."""
    if on_zero == "null":
        return F.try_divide(num, den)
    if on_zero == "inf":
        return F.when(den == 0, F.lit(float("inf"))).otherwise(F.try_divide(num, den))
    raise ValueError(f"on_zero must be 'null' or 'inf', not {on_zero!r}")


def directions(df: DataFrame, keys: list[str], bases: dict[str, str]) -> DataFrame:
    """Long form, one row per direction, from a single scan.

    ``bases`` maps an output name to a measure base.
    """
    sides = [
        F.struct(F.lit(d).alias("direction"), *[F.col(directional(b, d)).alias(n) for n, b in bases.items()])
        for d in DIRECTIONS
    ]
    return df.select(*keys, F.inline(F.array(*sides)))
