"""From long sensor readings to trips with times, distance and fuel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions import calendar as cal
from fairlead.functions import geo
from fairlead.functions import measures as m
from fairlead.operators import asof, scan
from fairlead.operators.reshape import pivot_telemetry
from fairlead.session import join_lookup

# Names of the position and speed parameters, and of fuel-rate ones.
LAT, LON, SOG = (
    "positioningsystem_latitude_deg_1", "positioningsystem_longitude_deg_1", "positioningsystem_sog_kn_1",
)
FUEL_MARK = "fuelcons_lph"
FIRST_DAY = "2023-04-30"  # fixed value: this day and earlier ones have no telemetry
FIRST_INSTANT = "2023-04-30T22:00:00"  # fixed value: first instant with telemetry
BUCKET_SECONDS = 5  # fixed value: spacing of the averaged samples


def fuel_parameters(df: DataFrame, param: str = "parameter_id") -> list[str]:
    """Names of the fuel-rate parameters present (a list as short as the sensor list)."""
    names = df.select(param).filter(F.col(param).contains(FUEL_MARK)).distinct()
    return sorted(r[0] for r in names.collect())


def wide_points(df: DataFrame, fuel: list[str] = (), lat: str = LAT, lon: str = LON, sog: str = SOG,
                vessel: str = "vessel_id", time: str = "time", tiebreak: str | None = None) -> DataFrame:
    """Pivoted samples with position and speed; incomplete ones drop out."""
    wide = pivot_telemetry(df, [lat, lon, sog, *fuel], [vessel, time], tiebreak=tiebreak)
    return m.complete(wide.withColumnsRenamed({lat: "lat", lon: "lon", sog: "sog"}), ["lat", "lon", "sog"])


def trip_points(points: DataFrame, by: list[str], time: str = "time", speed_kn: float = 1.0, stop_min: float = 1.0,
                zone: str = "CET", bounded: bool = False) -> DataFrame:
    """Moving samples numbered by trip, with the step from the previous sample in metres.

    The speed filter comes first: gaps are measured between the samples it keeps. Keys of
    ``bounded`` size, such as a vessel's day, are never dealt to ranges.
    """
    before = {time: "_time", "lat": "_lat", "lon": "_lon"}

    def step(rows: DataFrame, ranges: list[str]) -> DataFrame:
        rows = scan.neighbour(rows, ranges, by, [time], before).withColumn("dt", cal.seconds_between("_time", time))
        starts = F.coalesce(F.col("dt"), F.lit(0.0)) > stop_min * 60
        step_m = geo.haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
        rows = rows.withColumn("step_m", F.when(~starts, F.coalesce(step_m, F.lit(0.0))).otherwise(F.lit(0.0)))
        return scan.running(rows, ranges, by, [time], starts.cast("int"), "trip_no")

    rows = scan.by_ranges(m.moving(points, "sog", speed_kn), by, [time], step, bounded)
    return rows.withColumn("local_time", F.date_trunc("second", cal.local_time(time, zone))).drop("_time", "_lat", "_lon")


def fuel_sum(columns: list[str], dt_s: float = BUCKET_SECONDS) -> Column:
    """Litres over a trip from fuel rates per hour; null if any sample is missing."""
    if not columns:
        return F.lit(None).cast("double")
    litres = reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in columns]) * dt_s / 3600
    return F.when(F.count(litres) == F.count(F.lit(1)), F.sum(litres))


def trip_table(rows: DataFrame, by: list[str], fuel: list[str] = (), dt_s: float = BUCKET_SECONDS) -> DataFrame:
    """One row per trip of two points or more; sums only, no point lists."""
    return rows.groupBy(*by, "trip_no").agg(
        F.min("local_time").alias("start_time"), F.max("local_time").alias("end_time"),
        F.count(F.lit(1)).alias("n_points"), (F.sum("step_m") / m.METRES_PER_NM).alias("distance_nm"),
        fuel_sum(list(fuel), dt_s).alias("fuel_l"),
    ).filter(F.col("n_points") > 1)


def trip_paths(rows: DataFrame, by: list[str], extra: list[str] = (), time: str = "time",
               told: tuple[str, ...] = ("local_time", "lat", "lon", "sog")) -> DataFrame:
    """One row per trip with its time-ordered points."""
    point = F.struct(F.col(time).alias("t"), *told, *extra)
    ordered = F.array_sort(F.collect_list(point))
    out = rows.groupBy(*by, "trip_no").agg(ordered.alias("points")).filter(F.size("points") > 1)
    return out.withColumn("points", F.transform("points", lambda p: p.dropFields("t")))


def trips_from_telemetry(df: DataFrame, speed_kn: float = 1.0, stop_min: float = 1.0, lat: str = LAT, lon: str = LON,
                         sog: str = SOG, zone: str = "CET", fuel: list[str] = (), by: str = "vessel_id",
                         tiebreak: str | None = None) -> DataFrame:
    """Trips with their paths from long readings; no position or speed means no trips."""
    points = wide_points(df, list(fuel), lat, lon, sog, by, tiebreak=tiebreak)
    return trip_paths(trip_points(points, [by], "time", speed_kn, stop_min, zone), [by], list(fuel))


DERIVED = ("fuelcons_outbound_l", "distance_outbound_nm", "start_time_outbound", "end_time_outbound",
           "fuelcons_inbound_l", "distance_inbound_nm", "start_time_inbound", "end_time_inbound")


def round_trips(table: DataFrame, by: list[str], max_minutes: float | None = None, self_if_last: bool = True) -> DataFrame:
    """Each trip as an outbound one with the next of the same day as its inbound one."""
    names = {"fuel_l": "fuelcons_{}_l", "distance_nm": "distance_{}_nm", "start_time": "start_time_{}", "end_time": "end_time_{}"}
    following = {c: n.format("inbound") for c, n in names.items()}
    rows = asof.with_next(table, by, ["start_time", "trip_no"], following, self_if_last, bounded=True)
    if max_minutes is not None:
        short = cal.minutes_between("start_time", "end_time") <= max_minutes
        rows = rows.withColumns({c: F.when(short, F.col(c)) for c in following.values()})
    return rows.withColumns({n.format("outbound"): F.col(c) for c, n in names.items()})


def enrich_trips(trips: DataFrame, fleet: DataFrame, telemetry: DataFrame, tolerance_min: float = 5.0,
                 speed_kn: float = 1.0, stop_min: float = 1.0, zone: str = "CET", fuel: list[str] = (),
                 dt_s: float = BUCKET_SECONDS, max_minutes: float | None = None, tiebreak: str | None = None,
                 ferry: str = "ferry_name", departure: str = "time_departure",
                 after_day: str | None = FIRST_DAY) -> DataFrame:
    """Fill the eight derived columns of each departure from the telemetry of its ferry and day.

    Samples up to ``after_day`` are left out; null takes all.

    Samples and departures meet on (vessel, local day); nothing is larger than a vessel's day.
    """
    by = ["vessel_id", "day"]
    points = wide_points(telemetry, list(fuel), tiebreak=tiebreak).withColumn(
        "day", F.to_date(cal.local_time("time", zone))
    )
    if after_day is not None:
        points = points.filter(F.col("day") > F.lit(after_day).cast("date"))
    rows = trip_points(points, by, "time", speed_kn, stop_min, zone, bounded=True)
    table = round_trips(trip_table(rows, by, fuel, dt_s), by, max_minutes)
    names = fleet.select(F.lower("name").alias("_name"), "vessel_id")
    left = join_lookup(
        trips.drop(*DERIVED).withColumn("_name", F.lower(ferry)), names, "_name", "left"
    ).drop("_name").withColumn("day", F.to_date(departure))
    matched = asof.asof_nearest(
        left, table.select(*by, "trip_no", "start_time", *DERIVED), by, departure, "start_time",
        tolerance_min * 60, list(DERIVED), "trip_no", bounded=True,
    )
    return matched.drop("day", "vessel_id", "gap_seconds")


def write_back(trips: DataFrame, matched: DataFrame, keys: list[str], cols: list[str], order: list[str]) -> DataFrame:
    """Set columns on every row with the same key; of repeated matches the last in ``order`` counts."""
    latest = matched.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_new"))
    kept = trips.drop(*cols).join(latest, keys, "left")
    return kept.select(*[c for c in trips.columns if c not in cols], *[F.col("_new")[c].alias(c) for c in cols])


def telemetry_select(df: DataFrame, vessel: str, start: str, end: str, params: list[str], bucket: str | None = None,
                     watermark: str | None = None, first: str | None = FIRST_INSTANT) -> DataFrame:
    """Readings of one vessel in [start, end) whose parameter contains any of the names.

    With a bucket the averages of that width are returned, filtered by bucket start. A start
    before ``first`` is an error; null allows any. A table laid out by ``day`` is read for the days of the range alone.
    """
    from fairlead.streaming.stream import BUCKETS, bucket_average

    low, high = (F.lit(v).cast("timestamp_ntz") for v in (start, end))
    begin, finish = (_instant(v) for v in (start, end))
    if begin >= finish:
        raise ValueError("start must be before end")
    if first is not None and begin < _instant(first):
        raise ValueError(f"there is no telemetry before {first}")
    if bucket is not None and bucket not in BUCKETS:
        raise ValueError(f"unknown bucket {bucket!r}; choose one of {', '.join(BUCKETS)}")
    hit = reduce(lambda a, b: a | b, [F.col("parameter_id").ilike(f"%{p.replace('*', '%')}%") for p in params])
    rows = df.filter((F.col("vessel_id") == vessel) & hit)
    if dict(df.dtypes).get("day") == "date":
        # A bucket that starts in the range may reach into the next day.
        rows = rows.filter(F.col("day").between(F.to_date(low), F.date_add(F.to_date(high), 0 if bucket is None else 1)))
    kind = dict(df.dtypes)["time"]
    if bucket is None:
        return rows.filter((F.col("time") >= low.cast(kind)) & (F.col("time") < high.cast(kind)))
    # Samples of the buckets that start in the range lie before the end of the last such bucket.
    near = rows.filter((F.col("time") >= low.cast(kind)) & (F.col("time") < high.cast(kind) + F.expr(f"interval {bucket}")))
    buckets = bucket_average(near, bucket, watermark)
    return buckets.filter((F.col("bucket") >= low.cast(kind)) & (F.col("bucket") < high.cast(kind)))


def _instant(text: str):
    import datetime as dt
    return dt.datetime.fromisoformat(text)
