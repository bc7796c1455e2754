"""Nearest-in-time joins without a cross product."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.functions.calendar import micros
from fairlead.operators import scan
from fairlead.session import join_lookup


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str,
                 tolerance: float, payload: list[str], tiebreak: str, bounded: bool = False) -> DataFrame:
    """Add to each left row the right row nearest in time, if within ``tolerance`` seconds.

    On equal distance the earlier right row wins, and on equal times the lowest
    ``tiebreak``. Both sides are put in one order by key and time and scanned for the last right row
    before and the first after, so nothing is repeated and a hot key is spread by ranges of time. Every left row
    is kept; ``payload`` columns and ``gap_seconds`` are null without a match. A null key or time
    matches nothing. ``bounded`` keys fit a task by their nature.
    """
    reach = int(tolerance * 1_000_000)
    known = lambda t: reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by], t.isNotNull())
    base = left.withColumn("_t", micros(left_ts))
    record = F.struct(F.col("_t").alias("t"), F.col(tiebreak).alias("k"), *[F.col(c) for c in payload])
    # One candidate per instant: the lowest tiebreak.
    candidates = right.withColumn("_t", micros(right_ts)).filter(known(F.col("_t"))).groupBy(*by, "_t").agg(
        F.min_by(record, F.col(tiebreak)).alias("_right"))
    whole = F.struct(*left.columns).alias("_left")
    merged = base.filter(known(F.col("_t"))).select(*by, "_t", whole).unionByName(candidates, allowMissingColumns=True)
    found = scan.by_ranges(merged, by, ["_t"], lambda rows, ranges: scan.nearest_known(
        rows, ranges, by, "_t", "_right", "_back", "_ahead"), bounded, left.select(*by).unionByName(right.select(*by))).filter(
        F.col("_left").isNotNull())
    unmatched = base.filter(~known(F.col("_t"))).select(*by, "_t", whole)
    found = found.unionByName(unmatched, allowMissingColumns=True)
    d_back, d_ahead = F.col("_t") - F.col("_back.t"), F.col("_ahead.t") - F.col("_t")
    nearest = F.when(d_back.isNull() | (d_ahead < d_back), F.col("_ahead")).otherwise(F.col("_back"))
    gap = F.abs(F.col("_near.t") - F.col("_t"))
    close = gap <= reach
    return found.withColumn("_near", nearest).select(
        "_left.*",
        *[F.when(close, F.col("_near")[c]).alias(c) for c in payload],
        F.when(close, gap / 1e6).alias("gap_seconds"),
    )


def with_next(df: DataFrame, by: list[str], order: list[str], cols: dict[str, str],
              self_if_last: bool = True, bounded: bool = False) -> DataFrame:
    """Add the following row's values; the last row of a key repeats its own, or gets nulls."""
    following = {old: f"_next_{new}" for old, new in cols.items()}
    rows = scan.by_ranges(df, by, order, lambda rows, ranges: scan.neighbour(
        rows, ranges, by, order, following, ahead=True, there="_followed"), bounded)
    own = lambda old: F.col(old) if self_if_last else F.lit(None)
    return rows.withColumns({new: F.when(F.col("_followed"), F.col(f"_next_{new}")).otherwise(own(old)) for old, new in cols.items()}).drop(
        "_followed", *following.values())


def pair_inbound(trips: DataFrame, by: list[str], start: str = "start_time", end: str = "end_time",
                 tiebreak: str = "trip_no", max_minutes: float | None = None,
                 self_if_last: bool = True) -> DataFrame:
    """Give each trip its inbound one: the next of the day, or itself when it is the last.

    ``max_minutes`` also withholds the inbound trip of an outbound trip lasting longer.
    """
    paired = with_next(
        trips, by, [start, tiebreak],
        {tiebreak: f"inbound_{tiebreak}", start: f"inbound_{start}", end: f"inbound_{end}"}, self_if_last,
    )
    if max_minutes is None:
        return paired
    short = (micros(end) - micros(start)) <= int(max_minutes * 60_000_000)
    names = [f"inbound_{c}" for c in (tiebreak, start, end)]
    return paired.withColumns({n: F.when(short, F.col(n)) for n in names})


def match_timetable(trips: DataFrame, timetable: DataFrame, route: str, ts: str, slot: str,
                    tolerance_min: float = 5.0) -> DataFrame:
    """Nearest scheduled slot by time of day per route; trips without one are doubtful.

    ``slot`` holds seconds since midnight. Slots repeat one day before and after, so
    departures around midnight see the neighbouring day's slots.
    """
    day = F.date_trunc("day", F.col(ts))
    keyed = trips.withColumn("_second", (micros(ts) - micros(day)) / 1e6)
    # A clock time recurs every day: match each one once, then look it up.
    clocks = keyed.select(route, "_second").distinct().withColumn("_clock", F.timestamp_seconds("_second"))
    offsets = F.array(*[F.lit(float(d * 86_400)) for d in (-1, 0, 1)])
    slots = timetable.select(route, slot).distinct().select(route, slot, F.explode(offsets).alias("_day")).select(
        route, slot, F.timestamp_seconds(F.col(slot) + F.col("_day")).alias("_slot_clock")
    )
    matched = asof_nearest(
        clocks, slots, [route], "_clock", "_slot_clock", tolerance_min * 60, [slot], slot
    ).drop("_clock")
    return join_lookup(keyed, matched, [route, "_second"]).drop("_second").withColumn(
        "doubtful", F.col(slot).isNull()
    )
