"""Analyses of the wide trip table.

Each takes the whole table and groups by route or ferry; an entity argument only
adds a filter. Groups are few and rows many, so every job is one partial
aggregation whose shuffle carries one row per task and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairlead.functions import calendar as cal
from fairlead.functions import measures as m
from fairlead.session import join_lookup

TS = "time_departure"
PCE = "passenger_car_equivalent"
FUEL = "fuelcons_{}_l"
DISTANCE = "distance_{}_nm"
LEFT = "vehicles_left_at_terminal"
PEDESTRIANS = "pedestrians"
START, END = "start_time_{}", "end_time_{}"
OUT, IN = m.DIRECTIONS


def _only(df: DataFrame, column: str, value) -> DataFrame:
    return df if value is None else df.filter(F.col(column) == value)


def _count() -> Column:
    return F.count(F.lit(1))


def fuel_cost(trips: DataFrame, ferry=None, year=None, month=None, price: float = 20.0) -> DataFrame:
    """Fuel used in a period and its price, per ferry; missing sides count as zero."""
    rows = cal.calendar_filter(_only(trips, "ferry_name", ferry), TS, month=month, year=year)
    return rows.groupBy("ferry_name").agg(F.sum(m.both(FUEL)).alias("total_fuel_l")).withColumn(
        "total_cost", F.col("total_fuel_l") * price
    )


def average_speed(trips: DataFrame, ferry=None, unit: str = "kmh") -> DataFrame:
    """Mean over all single crossings of nautical miles per hour; no time means no speed."""
    convert = {"kn": lambda c: c, "kmh": m.to_kmh, "mph": m.to_mph}[unit]
    legs = m.directions(
        _only(trips, "ferry_name", ferry), ["ferry_name"], {"nm": DISTANCE, "start": START, "end": END}
    )
    knots = m.ratio(F.col("nm"), cal.hours_between("start", "end"))
    return legs.groupBy("ferry_name").agg(
        convert(F.avg(knots)).alias(f"avg_speed_{unit}"), F.count(knots).alias("n_crossings")
    )


def mean_left(trips: DataFrame, direction: str = IN) -> DataFrame:
    """Mean vehicles left behind in one direction, per route, over recorded values."""
    return trips.groupBy("route_name").agg(F.avg(f"{LEFT}_{direction}").alias("avg_left"))


def left_per_trip(trips: DataFrame, ferry=None, months=(6, 7, 8)) -> DataFrame:
    """Vehicles left in both directions per trip of a season; all trips are counted."""
    rows = cal.calendar_filter(_only(trips, "ferry_name", ferry), TS, months=list(months))
    return rows.groupBy("ferry_name").agg(
        F.sum(m.both(LEFT)).alias("total_left"), _count().alias("n_trips")
    ).withColumn("left_per_trip", F.coalesce(F.try_divide("total_left", "n_trips"), F.lit(0.0)))


def pce_by_weekday(trips: DataFrame, route=None) -> DataFrame:
    rows = _only(trips, "route_name", route)
    return rows.groupBy("route_name", F.weekday(TS).alias("weekday")).agg(
        F.avg(m.both(PCE)).alias("avg_pce"), _count().alias("n_trips")
    )


def peak_weekday(trips: DataFrame, route=None) -> DataFrame:
    """The weekday of the highest mean equivalent; Monday first on ties."""
    best = F.max_by(F.struct("weekday", "avg_pce", "n_trips"), F.struct("avg_pce", -F.col("weekday")))
    return pce_by_weekday(trips, route).groupBy("route_name").agg(best.alias("b")).select("route_name", "b.*")


def mean_distance(trips: DataFrame, route=None) -> DataFrame:
    return _only(trips, "route_name", route).groupBy("route_name").agg(
        F.avg(m.mean_of_both(DISTANCE)).alias("avg_distance_nm")
    )


def peak_hour(trips: DataFrame, route=None, month=None, year=None) -> DataFrame:
    """Hours with the highest summed equivalent outbound, inbound and in total."""
    rows = cal.calendar_filter(_only(trips, "route_name", route), TS, month=month, year=year)
    hourly = rows.groupBy("route_name", F.hour(TS).alias("hour")).agg(
        *[F.coalesce(F.sum(f"{PCE}_{d}"), F.lit(0.0)).alias(d) for d in m.DIRECTIONS]
    ).withColumn("total", F.col(OUT) + F.col(IN))
    peaks = []
    for name in (OUT, IN, "total"):
        key = F.struct(name, -F.col("hour"))
        peaks += [F.max_by("hour", key).alias(f"peak_hour_{name}"), F.max(name).alias(f"peak_pce_{name}")]
    return hourly.groupBy("route_name").agg(*peaks)


def mean_fuel(trips: DataFrame, route=None) -> DataFrame:
    """Mean fuel per trip over trips that recorded both directions."""
    out, back = (m.directional(FUEL, d) for d in m.DIRECTIONS)
    rows = m.complete(_only(trips, "route_name", route), [out, back])
    return rows.groupBy("route_name").agg(
        F.avg(out).alias("avg_fuel_outbound"), F.avg(back).alias("avg_fuel_inbound"),
        F.avg(F.col(out) + F.col(back)).alias("avg_fuel_total"), _count().alias("n_trips"),
    )


def mean_duration(trips: DataFrame, route=None) -> DataFrame:
    """Mean of the two directions' mean minutes."""
    sides = [F.avg(cal.minutes_between(START.format(d), END.format(d))).alias(d) for d in m.DIRECTIONS]
    return _only(trips, "route_name", route).groupBy("route_name").agg(*sides).select(
        "route_name", F.col(OUT).alias("avg_minutes_outbound"), F.col(IN).alias("avg_minutes_inbound"),
        ((F.col(OUT) + F.col(IN)) / 2).alias("avg_minutes"),
    )


def fuel_efficiency(trips: DataFrame) -> DataFrame:
    """Litres per nautical mile per ferry over complete trips, best first."""
    cols = [m.directional(b, d) for b in (FUEL, DISTANCE) for d in m.DIRECTIONS]
    return m.complete(trips, cols).groupBy("ferry_name").agg(
        F.sum(m.both(FUEL, "propagate")).alias("total_fuel_l"),
        F.sum(m.both(DISTANCE, "propagate")).alias("total_distance_nm"),
    ).withColumn("l_per_nm", m.ratio(F.col("total_fuel_l"), F.col("total_distance_nm"))).orderBy(
        F.col("l_per_nm").asc_nulls_last(), "ferry_name"
    )


def with_capacity(rows: DataFrame, fleet: DataFrame, name: str = "ferry_name",
                  capacity: str = "capacity_passenger_car_equivalent") -> DataFrame:
    """Add the capacity of the ferry; names match without regard to case."""
    lookup = fleet.select(F.lower("name").alias("_name"), F.col(capacity).alias("capacity"))
    return join_lookup(rows.withColumn("_name", F.lower(name)), lookup, "_name", "left").drop("_name")


def utilisation(trips: DataFrame, fleet: DataFrame, route=None, by: str = "ferry_name") -> DataFrame:
    """Mean of the directions' mean equivalents as a share of the ferry's capacity."""
    rows = _only(trips, "route_name", route).groupBy(by).agg(
        *[F.avg(f"{PCE}_{d}").alias(d) for d in m.DIRECTIONS]
    ).select(by, ((F.col(OUT) + F.col(IN)) / 2).alias("avg_pce"))
    # Aggregated before the lookup: one row per ferry joins, not one per trip.
    return with_capacity(rows, fleet, by).withColumn(
        "utilisation_pct", m.ratio(F.col("avg_pce"), F.col("capacity")) * 100
    )


def left_by_route_month(trips: DataFrame) -> DataFrame:
    return trips.groupBy("route_name", cal.year_month(TS).alias("year_month")).agg(
        F.avg(m.both(LEFT)).alias("avg_left")
    )


def left_in_month(trips: DataFrame, route: str, suffix: str = "-06") -> DataFrame:
    """A route's value in the first month that ends with ``suffix``."""
    rows = left_by_route_month(trips.filter(F.col("route_name") == route))
    return rows.filter(F.col("year_month").endswith(suffix)).groupBy("route_name").agg(
        F.min("year_month").alias("year_month"), F.min_by("avg_left", "year_month").alias("avg_left")
    )


def daily_throughput(trips: DataFrame, route=None, classes=m.ROAD_CLASSES, directions=(OUT,)) -> DataFrame:
    """Vehicles per observed day: mean, least, most and number of days."""
    daily = _only(trips, "route_name", route).groupBy("route_name", F.to_date(TS).alias("day")).agg(
        F.sum(m.vehicles(classes, directions)).alias("n")
    )
    return daily.groupBy("route_name").agg(
        F.avg("n").alias("avg_daily"), F.min("n").alias("min_daily"), F.max("n").alias("max_daily"),
        _count().alias("n_days"),
    )


def _macro_mean(rows: DataFrame, out: str = "avg_pce", zero: bool = False) -> DataFrame:
    value = lambda d: F.coalesce(F.col(f"{PCE}_{d}"), F.lit(0.0)) if zero else F.col(f"{PCE}_{d}")
    return rows.groupBy("route_name").agg(*[F.avg(value(d)).alias(d) for d in m.DIRECTIONS]).select(
        "route_name", ((F.col(OUT) + F.col(IN)) / 2).alias(out)
    )


def mean_pce_on(trips: DataFrame, route=None, weekday: int = 3) -> DataFrame:
    """Mean of the directions' means on one weekday (Thursday by default)."""
    return _macro_mean(_only(trips, "route_name", route).filter(cal.weekday_is(TS, weekday)))


def fill_spine(df: DataFrame, key: str, start: int, end: int, by: list[str], fill: dict) -> DataFrame:
    """One row per key in [start, end) and group; absent measures take the fill values."""
    spine = df.select(*by).distinct().withColumn(key, F.explode(F.sequence(F.lit(start), F.lit(end - 1))))
    return spine.join(df, [*by, key], "left").fillna(fill)


def hourly_profile(trips: DataFrame, route=None) -> DataFrame:
    """Mean equivalents and trip count for each of the 24 hours; hours without trips hold zeros."""
    hourly = _only(trips, "route_name", route).groupBy("route_name", F.hour(TS).alias("hour")).agg(
        F.avg(f"{PCE}_{OUT}").alias("avg_pce_outbound"), F.avg(f"{PCE}_{IN}").alias("avg_pce_inbound"),
        F.avg(m.both(PCE)).alias("avg_pce_total"), _count().alias("n_trips"),
    )
    zeros = {"avg_pce_outbound": 0.0, "avg_pce_inbound": 0.0, "avg_pce_total": 0.0, "n_trips": 0}
    return fill_spine(hourly, "hour", 0, 24, ["route_name"], zeros)


def hourly_peaks(profile: DataFrame) -> DataFrame:
    """Peak hours of an hourly profile, the lowest hour on ties."""
    peaks = []
    for name in ("outbound", "inbound", "total"):
        col = f"avg_pce_{name}"
        peaks += [F.max_by("hour", F.struct(col, -F.col("hour"))).alias(f"peak_hour_{name}"),
                  F.max(col).alias(f"peak_{name}")]
    return profile.groupBy("route_name").agg(*peaks)


def season_pce(trips: DataFrame, route=None, months=(6, 7, 8)) -> DataFrame:
    rows = cal.calendar_filter(_only(trips, "route_name", route), TS, months=list(months))
    return _macro_mean(rows, zero=True)


def season_pce_by_month(trips: DataFrame, route=None, months=(6, 7, 8)) -> DataFrame:
    rows = cal.calendar_filter(_only(trips, "route_name", route), TS, months=list(months))
    value = lambda d: F.avg(F.coalesce(F.col(f"{PCE}_{d}"), F.lit(0.0)))
    return by_month(rows, ["route_name"], avg_pce=(value(OUT) + value(IN)) / 2, n_trips=_count())


def by_month(df: DataFrame, by: list[str], ts: str = TS, **aggs: Column) -> DataFrame:
    """Aggregates per month number, with the month's name."""
    return df.groupBy(*by, F.month(ts).alias("month")).agg(
        F.first(cal.month_name(ts)).alias("month_name"), *[a.alias(n) for n, a in aggs.items()]
    )


def ped_ratio_weekday_weekend(trips: DataFrame, route=None) -> DataFrame:
    """Pedestrians per vehicle on weekdays and weekends, and their relative difference."""
    weekend = cal.is_weekend(TS)
    walkers, cars = m.both(PEDESTRIANS), m.vehicles()
    aggs = []
    for name, side in (("weekday", ~weekend), ("weekend", weekend)):
        aggs += [
            F.sum(F.when(side, walkers)).alias(f"_p_{name}"), F.sum(F.when(side, cars)).alias(f"_v_{name}"),
            F.count_if(side).alias(f"n_{name}"),
        ]
    wd, we = (m.ratio(F.col(f"_p_{n}"), F.col(f"_v_{n}")) for n in ("weekday", "weekend"))
    return _only(trips, "route_name", route).groupBy("route_name").agg(*aggs).select(
        "route_name", wd.alias("weekday_ratio"), we.alias("weekend_ratio"),
        (m.ratio(wd - we, we) * 100).alias("difference_pct"), "n_weekday", "n_weekend",
    )


def mean_pce_by_hour(trips: DataFrame, route=None) -> DataFrame:
    return _only(trips, "route_name", route).groupBy("route_name", F.hour(TS).alias("hour")).agg(
        F.avg(m.both(PCE)).alias("avg_pce"), _count().alias("n_trips")
    )


def top_hours(trips: DataFrame, route: str, n: int = 5) -> DataFrame:
    """The n hours of the highest mean equivalent, the lowest hour first on ties."""
    return mean_pce_by_hour(trips, route).orderBy(F.desc("avg_pce"), "hour").limit(n)


def top_hours_by_route(trips: DataFrame, n: int = 5) -> DataFrame:
    order = W.partitionBy("route_name").orderBy(F.desc("avg_pce"), "hour")
    # At most 24 rows reach the window per route.
    return mean_pce_by_hour(trips).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def ped_ratio(trips: DataFrame, route=None, year=None) -> DataFrame:
    """Pedestrians per vehicle in a year; infinite without vehicles."""
    rows = cal.calendar_filter(_only(trips, "route_name", route), TS, year=year)
    return rows.groupBy("route_name").agg(
        F.sum(m.both(PEDESTRIANS)).alias("pedestrians"), F.sum(m.vehicles()).alias("vehicles")
    ).withColumn("ratio", m.ratio(F.col("pedestrians"), F.col("vehicles"), "inf"))


def ped_ratio_by_month(trips: DataFrame, route=None, year=None) -> DataFrame:
    rows = cal.calendar_filter(_only(trips, "route_name", route), TS, year=year)
    return by_month(
        rows, ["route_name"], pedestrians=F.sum(m.both(PEDESTRIANS)), vehicles=F.sum(m.vehicles())
    ).withColumn("ratio", m.ratio(F.col("pedestrians"), F.col("vehicles")))


def co2(trips: DataFrame, route=None, year=None, month=None, factor: float = m.KG_CO2_PER_LITRE) -> DataFrame:
    rows = cal.calendar_filter(_only(trips, "route_name", route), TS, month=month, year=year)
    return rows.groupBy("route_name").agg(F.sum(m.both(FUEL)).alias("total_fuel_l")).withColumn(
        "co2_kg", F.col("total_fuel_l") * factor
    ).withColumn("co2_tonnes", m.to_tonnes(F.col("co2_kg")))


def histogram(df: DataFrame, col: str | Column, width: float, by: list[str] = ()) -> DataFrame:
    """Rows per bucket of the given width; the bucket is named by its lower bound."""
    value = F.col(col) if isinstance(col, str) else col
    return df.filter(value.isNotNull()).groupBy(
        *by, (F.floor(value / width) * width).cast("double").alias("bucket")
    ).agg(_count().alias("n"))


def savings(trips: DataFrame, share: float = 0.2, price: float = 20.0) -> DataFrame:
    """Fuel and cost per year saved by cutting a share of the trips in low-demand hours.

    Hours of a route with a mean equivalent below the route's median hour are low.
    """
    hourly = trips.groupBy("route_name", F.year(TS).alias("year"), F.hour(TS).alias("hour")).agg(
        F.sum(m.both(PCE)).alias("_pce"), F.sum(m.both(FUEL)).alias("fuel_l"), _count().alias("n_trips")
    )
    # At most 24 rows per route and year reach the window.
    demand = W.partitionBy("route_name", "year").orderBy(F.col("_pce") / F.col("n_trips"))
    low = hourly.withColumn("_rank", F.percent_rank().over(demand)).filter(F.col("_rank") < 0.5)
    return low.groupBy("route_name", "year").agg(
        F.sum("n_trips").alias("low_demand_trips"), (F.sum("fuel_l") * share).alias("fuel_saved_l")
    ).withColumn("cost_saved", F.col("fuel_saved_l") * price)


def fuel_profile(trips: DataFrame) -> DataFrame:
    """Fuel and demand by route, weekday and hour, with subtotals (null marks 'all')."""
    rows = trips.select(
        "route_name", F.weekday(TS).alias("weekday"), F.hour(TS).alias("hour"),
        m.both(FUEL).alias("_fuel"), m.both(PCE).alias("_pce"),
    )
    return rows.rollup("route_name", "weekday", "hour").agg(
        F.grouping_id().alias("level"), F.sum("_fuel").alias("fuel_l"), F.avg("_fuel").alias("avg_fuel_l"),
        F.avg("_pce").alias("avg_pce"), _count().alias("n_trips"),
    )


def fleet_report(fleet: DataFrame, year: int) -> DataFrame:
    """Power, size and age figures per ferry from the nested registry."""
    capacity = F.col("capacity_passenger_car_equivalent")
    engines, drives = F.col("machinery.engines"), F.col("machinery.propulsion")

    def mean_age(items: Column) -> Column:
        years = F.filter(F.transform(items, lambda e: e["year_manufactured"]), lambda y: y.isNotNull())
        total = F.aggregate(years, F.lit(0.0), lambda acc, y: acc + (F.lit(year) - y))
        return F.try_divide(total, F.size(years))

    return fleet.select(
        "name", F.try_divide("installed_power_kw", capacity).alias("kw_per_pce"),
        F.try_divide("length_over_all_m", capacity).alias("length_per_pce"),
        F.try_divide("breadth_m", capacity).alias("breadth_per_pce"),
        F.coalesce(F.size(engines), F.lit(0)).alias("n_engines"), mean_age(engines).alias("avg_engine_age"),
        F.coalesce(F.size(drives), F.lit(0)).alias("n_propulsion"), mean_age(drives).alias("avg_propulsion_age"),
    )


def propulsion_types(fleet: DataFrame) -> DataFrame:
    """Number of units and ferries per propulsion type."""
    units = fleet.select("name", F.explode("machinery.propulsion").alias("p"))
    return units.groupBy(F.col("p.type").alias("type")).agg(
        _count().alias("n_units"), F.countDistinct("name").alias("n_ferries")
    )
