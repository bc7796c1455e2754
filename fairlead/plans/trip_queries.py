"""Trip analyses over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.functions import calendar as cal
from fairlead.functions import measures as m
from fairlead.operators import reshape, trips as t
from fairlead.plans import bindings as b
from fairlead.plans.registry import query

W = f"WITH {b.TRIPS_SQL}"
BOTH = "(coalesce({0}_outbound, 0) + coalesce({0}_inbound, 0))"
PCE = BOTH.format("passenger_car_equivalent")
LEFT = BOTH.format("vehicles_left_at_terminal")
WALK = BOTH.format("pedestrians")
FUEL = "(coalesce(fuelcons_outbound_l, 0) + coalesce(fuelcons_inbound_l, 0))"
VEH = "(" + " + ".join(
    f"coalesce({c}_{d}, 0)" for d in ("outbound", "inbound")
    for c in ("cars", "trucks", "trucks_with_trailer", "motorcycles", "buses")) + ")"
MINUTES = "epoch(end_time_{0} - start_time_{0}) / 60.0"


@query("A-1", f"""{W} SELECT ferry_name, round(sum({FUEL}), 6) AS total_fuel_l, round(sum({FUEL}) * 20, 6) AS total_cost
  FROM trips WHERE year(time_departure) = 1997 AND month(time_departure) = 1 GROUP BY ferry_name""")
def fuel_cost(spark, d):
    return t.fuel_cost(b.trips(spark, d, 1997, 1), year=1997, month=1, price=20.0)


@query("A-2", f"""{W}, legs AS (
    SELECT ferry_name, distance_outbound_nm AS nm, epoch(end_time_outbound - start_time_outbound) / 3600.0 AS h FROM trips
    UNION ALL
    SELECT ferry_name, distance_inbound_nm, epoch(end_time_inbound - start_time_inbound) / 3600.0 FROM trips)
  SELECT ferry_name, round(avg(nm / nullif(h, 0)) * 1.852, 6) AS avg_speed_kmh,
         count(nm / nullif(h, 0)) AS n_crossings FROM legs GROUP BY ferry_name""")
def average_speed(spark, d):
    return t.average_speed(b.trips(spark, d))


@query("A-3", f"{W} SELECT route_name, round(avg(vehicles_left_at_terminal_inbound), 6) AS avg_left FROM trips GROUP BY 1")
def mean_left(spark, d):
    return t.mean_left(b.trips(spark, d))


@query("A-4", f"""{W} SELECT ferry_name, CAST(sum({LEFT}) AS DOUBLE) AS total_left, count(*) AS n_trips,
    round(sum({LEFT}) / count(*), 6) AS left_per_trip
  FROM trips WHERE month(time_departure) IN (6, 7, 8) GROUP BY 1""")
def left_per_trip(spark, d):
    return t.left_per_trip(b.trips(spark, d))


WEEKDAY = f"""by_day AS (SELECT route_name, isodow(time_departure) - 1 AS weekday, avg({PCE}) AS avg_pce, count(*) AS n_trips
    FROM trips GROUP BY 1, 2)"""


@query("A-5", f"{W}, {WEEKDAY} SELECT route_name, weekday, round(avg_pce, 6) AS avg_pce, n_trips FROM by_day")
def pce_by_weekday(spark, d):
    return t.pce_by_weekday(b.trips(spark, d))


@query("A-5-peak", f"""{W}, {WEEKDAY} SELECT route_name, weekday, round(avg_pce, 6) AS avg_pce, n_trips FROM by_day
  QUALIFY row_number() OVER (PARTITION BY route_name ORDER BY avg_pce DESC, weekday) = 1""")
def peak_weekday(spark, d):
    return t.peak_weekday(b.trips(spark, d))


@query("A-6", f"""{W} SELECT route_name, round(avg((distance_outbound_nm + distance_inbound_nm) / 2), 6) AS avg_distance_nm
  FROM trips GROUP BY 1""")
def mean_distance(spark, d):
    return t.mean_distance(b.trips(spark, d))


def _peak(name):
    return (f"arg_max(hour, {name} * 100.0 - hour) AS peak_hour_{name}, round(max({name}), 6) AS peak_pce_{name}")


@query("A-7", f"""{W}, hourly AS (SELECT route_name, hour(time_departure) AS hour,
      coalesce(sum(passenger_car_equivalent_outbound), 0) AS outbound,
      coalesce(sum(passenger_car_equivalent_inbound), 0) AS inbound
    FROM trips WHERE month(time_departure) = 2 GROUP BY 1, 2),
  h AS (SELECT *, outbound + inbound AS total FROM hourly)
  SELECT route_name, {_peak("outbound")}, {_peak("inbound")}, {_peak("total")} FROM h GROUP BY route_name""")
def peak_hour(spark, d):
    return t.peak_hour(b.trips(spark, d), month=2)


@query("A-8", f"""{W} SELECT route_name, round(avg(fuelcons_outbound_l), 6) AS avg_fuel_outbound,
    round(avg(fuelcons_inbound_l), 6) AS avg_fuel_inbound,
    round(avg(fuelcons_outbound_l + fuelcons_inbound_l), 6) AS avg_fuel_total, count(*) AS n_trips
  FROM trips WHERE fuelcons_outbound_l IS NOT NULL AND fuelcons_inbound_l IS NOT NULL GROUP BY 1""")
def mean_fuel(spark, d):
    return t.mean_fuel(b.trips(spark, d))


@query("A-9", f"""{W} SELECT route_name, round(avg({MINUTES.format("outbound")}), 6) AS avg_minutes_outbound,
    round(avg({MINUTES.format("inbound")}), 6) AS avg_minutes_inbound,
    round((avg({MINUTES.format("outbound")}) + avg({MINUTES.format("inbound")})) / 2, 6) AS avg_minutes
  FROM trips GROUP BY 1""")
def mean_duration(spark, d):
    return t.mean_duration(b.trips(spark, d))


@query("A-10", f"""{W} SELECT ferry_name, round(sum(fuelcons_outbound_l + fuelcons_inbound_l), 6) AS total_fuel_l,
    round(sum(distance_outbound_nm + distance_inbound_nm), 6) AS total_distance_nm,
    round(sum(fuelcons_outbound_l + fuelcons_inbound_l) / sum(distance_outbound_nm + distance_inbound_nm), 6) AS l_per_nm
  FROM trips WHERE fuelcons_outbound_l IS NOT NULL AND fuelcons_inbound_l IS NOT NULL
    AND distance_outbound_nm IS NOT NULL AND distance_inbound_nm IS NOT NULL GROUP BY 1""")
def fuel_efficiency(spark, d):
    return t.fuel_efficiency(b.trips(spark, d))


MACRO = "(avg(passenger_car_equivalent_outbound) + avg(passenger_car_equivalent_inbound)) / 2"


@query("A-11", f"""{W}, {b.FLEET_SQL}, used AS (SELECT n_name AS ferry_name, {MACRO} AS avg_pce
    FROM trips JOIN nation ON vessel_no = n_nationkey GROUP BY 1)
  SELECT ferry_name, round(avg_pce, 6) AS avg_pce, capacity, round(avg_pce / capacity * 100, 6) AS utilisation_pct
  FROM used LEFT JOIN fleet ON lower(ferry_name) = name""")
def utilisation(spark, d):
    return t.utilisation(b.trips_by_vessel(spark, d), b.fleet(spark, d))


BY_MONTH = f"""m AS (SELECT route_name, strftime(time_departure, '%Y-%m') AS year_month, avg({LEFT}) AS avg_left
    FROM trips GROUP BY 1, 2)"""


@query("A-12", f"{W}, {BY_MONTH} SELECT route_name, year_month, round(avg_left, 6) AS avg_left FROM m")
def left_by_route_month(spark, d):
    return t.left_by_route_month(b.trips(spark, d))


@query("A-12-month", f"""{W}, {BY_MONTH} SELECT route_name, year_month, round(avg_left, 6) AS avg_left FROM m
  WHERE route_name = '2-HIGH' AND year_month LIKE '%-06'
  QUALIFY row_number() OVER (PARTITION BY route_name ORDER BY year_month) = 1""")
def left_in_month(spark, d):
    return t.left_in_month(b.trips(spark, d), "2-HIGH")


@query("A-13", f"""{W}, daily AS (SELECT route_name, CAST(time_departure AS DATE) AS day,
      sum(coalesce(cars_outbound, 0) + coalesce(trucks_outbound, 0) + coalesce(trucks_with_trailer_outbound, 0)) AS n
    FROM trips GROUP BY 1, 2)
  SELECT route_name, round(avg(n), 6) AS avg_daily, min(n) AS min_daily, max(n) AS max_daily, count(*) AS n_days
  FROM daily GROUP BY 1""")
def daily_throughput(spark, d):
    return t.daily_throughput(b.trips(spark, d))


@query("A-14", f"""{W} SELECT route_name, round({MACRO}, 6) AS avg_pce FROM trips
  WHERE isodow(time_departure) = 4 GROUP BY 1""")
def mean_pce_on(spark, d):
    return t.mean_pce_on(b.trips(spark, d))


PROFILE = f"""profile AS (
    SELECT s.route_name, s.hour, coalesce(avg(passenger_car_equivalent_outbound), 0) AS avg_pce_outbound,
           coalesce(avg(passenger_car_equivalent_inbound), 0) AS avg_pce_inbound,
           coalesce(avg(CASE WHEN trip_id IS NOT NULL THEN {PCE} END), 0) AS avg_pce_total, count(trip_id) AS n_trips
    FROM (SELECT DISTINCT route_name, unnest(range(24)) AS hour FROM trips) s
    LEFT JOIN trips ON trips.route_name = s.route_name AND hour(time_departure) = s.hour GROUP BY 1, 2)"""


@query("A-15", f"""{W}, {PROFILE} SELECT route_name, hour, round(avg_pce_outbound, 6) AS avg_pce_outbound,
  round(avg_pce_inbound, 6) AS avg_pce_inbound, round(avg_pce_total, 6) AS avg_pce_total, n_trips FROM profile""")
def hourly_profile(spark, d):
    return t.hourly_profile(b.trips(spark, d))


def _profile_peak(name):
    return f"""arg_max(hour, avg_pce_{name} * 100000.0 - hour) AS peak_hour_{name},
    round(max(avg_pce_{name}), 6) AS peak_{name}"""


@query("A-15-peaks", f"""{W}, {PROFILE} SELECT route_name, {_profile_peak("outbound")}, {_profile_peak("inbound")},
  {_profile_peak("total")} FROM profile GROUP BY 1""")
def hourly_peaks(spark, d):
    return t.hourly_peaks(t.hourly_profile(b.trips(spark, d)))


ZERO_MACRO = """(avg(coalesce(passenger_car_equivalent_outbound, 0))
    + avg(coalesce(passenger_car_equivalent_inbound, 0))) / 2"""


@query("A-16", f"""{W} SELECT route_name, round({ZERO_MACRO}, 6) AS avg_pce FROM trips
  WHERE month(time_departure) IN (6, 7, 8) GROUP BY 1""")
def season_pce(spark, d):
    return t.season_pce(b.trips(spark, d))


@query("A-17", f"""{W}, r AS (SELECT route_name,
      sum(CASE WHEN isodow(time_departure) < 6 THEN {WALK} END) / sum(CASE WHEN isodow(time_departure) < 6 THEN {VEH} END) AS wd,
      sum(CASE WHEN isodow(time_departure) >= 6 THEN {WALK} END) / sum(CASE WHEN isodow(time_departure) >= 6 THEN {VEH} END) AS we,
      count(*) FILTER (isodow(time_departure) < 6) AS n_weekday, count(*) FILTER (isodow(time_departure) >= 6) AS n_weekend
    FROM trips GROUP BY 1)
  SELECT route_name, round(wd, 6) AS weekday_ratio, round(we, 6) AS weekend_ratio,
    round((wd - we) / we * 100, 6) AS difference_pct, n_weekday, n_weekend FROM r""")
def ped_ratio_weekday_weekend(spark, d):
    return t.ped_ratio_weekday_weekend(b.trips(spark, d))


HOURLY = f"h AS (SELECT route_name, hour(time_departure) AS hour, avg({PCE}) AS avg_pce, count(*) AS n_trips FROM trips GROUP BY 1, 2)"


@query("A-18", f"""{W}, {HOURLY} SELECT route_name, hour, round(avg_pce, 6) AS avg_pce, n_trips,
    row_number() OVER (PARTITION BY route_name ORDER BY avg_pce DESC, hour) AS place FROM h
  QUALIFY row_number() OVER (PARTITION BY route_name ORDER BY avg_pce DESC, hour) <= 5""")
def top_hours_by_route(spark, d):
    return t.top_hours_by_route(b.trips(spark, d))


@query("T-4", f"""{W}, {HOURLY} SELECT route_name, hour, round(avg_pce, 6) AS avg_pce, n_trips FROM h
  WHERE route_name = '5-LOW' ORDER BY h.avg_pce DESC, hour LIMIT 5""")
def top_hours(spark, d):
    return t.top_hours(b.trips(spark, d), "5-LOW", 5)


@query("A-19", f"""{W}, r AS (SELECT route_name, CAST(sum({WALK}) AS DOUBLE) AS p, CAST(sum({VEH}) AS DOUBLE) AS v
    FROM trips WHERE year(time_departure) = 1997 GROUP BY 1)
  SELECT route_name, p AS pedestrians, v AS vehicles,
    round(CASE WHEN v = 0 THEN CAST('inf' AS DOUBLE) ELSE p / v END, 6) AS ratio FROM r""")
def ped_ratio(spark, d):
    return t.ped_ratio(b.trips(spark, d, 1997), year=1997)


@query("A-20", f"""{W} SELECT route_name, round(sum({FUEL}), 6) AS total_fuel_l, round(sum({FUEL}) * 2.68, 6) AS co2_kg,
    round(sum({FUEL}) * 2.68 / 1000, 6) AS co2_tonnes
  FROM trips WHERE year(time_departure) = 1996 AND month(time_departure) = 12 GROUP BY 1""")
def co2(spark, d):
    return t.co2(b.trips(spark, d, 1996, 12), year=1996, month=12)


@query("A-34", f"""{W} SELECT route_name, CAST(floor({PCE} / 25.0) * 25 AS DOUBLE) AS bucket, count(*) AS n
  FROM trips GROUP BY 1, 2""")
def histogram(spark, d):
    return t.histogram(b.trips(spark, d), m.both("passenger_car_equivalent"), 25.0, ["route_name"])


@query("A-35", f"""{W}, h AS (SELECT route_name, year(time_departure) AS year, hour(time_departure) AS hour,
      avg({PCE}) AS demand, sum({FUEL}) AS fuel, count(*) AS n FROM trips GROUP BY 1, 2, 3),
  r AS (SELECT *, percent_rank() OVER (PARTITION BY route_name, year ORDER BY demand) AS pr FROM h)
  SELECT route_name, year, CAST(sum(n) AS BIGINT) AS low_demand_trips, round(sum(fuel) * 0.2, 6) AS fuel_saved_l,
    round(sum(fuel) * 0.2 * 20, 6) AS cost_saved FROM r WHERE pr < 0.5 GROUP BY 1, 2""")
def savings(spark, d):
    return t.savings(b.trips(spark, d))


@query("A-36", f"""WITH {b.VESSELS_SQL},
  e AS (SELECT s_suppkey, count(*) AS n, avg(2024 - made) AS age FROM engines GROUP BY 1),
  p AS (SELECT s_suppkey, count(*) AS n, avg(2024 - made) AS age FROM drives GROUP BY 1),
  v AS (SELECT *, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 90 + 10 END AS cap FROM supplier)
  SELECT lower(s_name) AS name, round(s_acctbal / cap, 6) AS kw_per_pce, round((s_suppkey % 60 + 20) / cap, 6) AS length_per_pce,
    round((s_suppkey % 5 + 8) / cap, 6) AS breadth_per_pce, coalesce(e.n, 0) AS n_engines, round(e.age, 6) AS avg_engine_age,
    coalesce(p.n, 0) AS n_propulsion, round(p.age, 6) AS avg_propulsion_age
  FROM v LEFT JOIN e USING (s_suppkey) LEFT JOIN p USING (s_suppkey)""")
def fleet_report(spark, d):
    return t.fleet_report(b.vessels(spark, d), 2024)


@query("A-36-types", f"""WITH {b.VESSELS_SQL} SELECT type, count(*) AS n_units, count(DISTINCT s_suppkey) AS n_ferries
  FROM drives GROUP BY 1""")
def propulsion_types(spark, d):
    return t.propulsion_types(b.vessels(spark, d))


@query("A-37", f"""{W}, x AS (SELECT route_name, isodow(time_departure) - 1 AS weekday, hour(time_departure) AS hour,
      {FUEL} AS fuel, {PCE} AS pce FROM trips)
  SELECT route_name, weekday, hour, grouping_id(route_name, weekday, hour) AS level, round(sum(fuel), 6) AS fuel_l,
    round(avg(pce), 6) AS avg_pce, count(*) AS n_trips
  FROM x GROUP BY ROLLUP (route_name, weekday, hour)""")
def fuel_profile(spark, d):
    # Means of few five-decimal values fall on rounding ties, so only their sums are compared.
    return t.fuel_profile(b.trips(spark, d)).drop("avg_fuel_l")


@query("A-38", f"""{W} SELECT route_name, month(time_departure) AS month, monthname(time_departure) AS month_name,
    round({ZERO_MACRO}, 6) AS avg_pce, count(*) AS n_trips
  FROM trips WHERE month(time_departure) IN (6, 7, 8) GROUP BY 1, 2, 3""")
def season_pce_by_month(spark, d):
    return t.season_pce_by_month(b.trips(spark, d))


@query("A-38-ratio", f"""{W} SELECT route_name, month(time_departure) AS month, monthname(time_departure) AS month_name,
    CAST(sum({WALK}) AS DOUBLE) AS pedestrians, CAST(sum({VEH}) AS DOUBLE) AS vehicles,
    round(sum({WALK}) / nullif(sum({VEH}), 0), 6) AS ratio
  FROM trips WHERE year(time_departure) = 1997 GROUP BY 1, 2, 3""")
def ped_ratio_by_month(spark, d):
    return t.ped_ratio_by_month(b.trips(spark, d, 1997), year=1997)


# Predicates and projections


@query("P-1", f"""{W} SELECT trip_id, ferry_name, time_departure FROM trips
  WHERE ferry_name = 'BUILDING' AND year(time_departure) = 1998 AND month(time_departure) = 3""")
def calendar_filter(spark, d):
    rows = b.trips(spark, d, 1998, 3).filter(F.col("ferry_name") == "BUILDING")
    return cal.calendar_filter(rows, "time_departure", month=3, year=1998).select("trip_id", "ferry_name", "time_departure")


@query("P-2", f"{W} SELECT trip_id, route_name FROM trips WHERE month(time_departure) IN (6, 7, 8)")
def season_filter(spark, d):
    return cal.calendar_filter(b.trips(spark, d), "time_departure", months=[6, 7, 8]).select("trip_id", "route_name")


@query("P-3", f"""{W} SELECT trip_id, isodow(time_departure) = 4 AS is_thursday, isodow(time_departure) >= 6 AS is_weekend
  FROM trips""")
def weekday_flags(spark, d):
    return b.trips(spark, d).select(
        "trip_id", cal.weekday_is("time_departure", 3).alias("is_thursday"),
        cal.is_weekend("time_departure").alias("is_weekend"))


@query("P-4", f"{W} SELECT trip_id, round({PCE}, 6) AS total_pce, round({FUEL}, 6) AS total_fuel FROM trips")
def zero_sum(spark, d):
    return b.trips(spark, d).select(
        "trip_id", m.both(t.PCE).alias("total_pce"), m.both(t.FUEL).alias("total_fuel"))


@query("P-5", f"{W} SELECT trip_id, round((distance_outbound_nm + distance_inbound_nm) / 2, 6) AS mean_nm FROM trips")
def null_mean(spark, d):
    return b.trips(spark, d).select("trip_id", m.mean_of_both(t.DISTANCE).alias("mean_nm"))


@query("P-6", f"""{W} SELECT trip_id FROM trips WHERE fuelcons_outbound_l IS NOT NULL AND fuelcons_inbound_l IS NOT NULL
  AND cars_outbound IS NOT NULL""")
def complete(spark, d):
    cols = ["fuelcons_outbound_l", "fuelcons_inbound_l", "cars_outbound"]
    return m.complete(b.trips(spark, d), cols).select("trip_id")


@query("P-7", "SELECT event_id, value FROM events WHERE value >= 1.0")
def moving(spark, d):
    return m.moving(b.table(spark, d, "events"), "value", 1.0).select("event_id", "value")


@query("P-8", f"""{W} SELECT trip_id, CAST({VEH} AS DOUBLE) AS all_vehicles,
    CAST(coalesce(cars_outbound, 0) + coalesce(trucks_outbound, 0) + coalesce(trucks_with_trailer_outbound, 0) AS DOUBLE)
      AS road_outbound FROM trips""")
def vehicles(spark, d):
    return b.trips(spark, d).select(
        "trip_id", m.vehicles().cast("double").alias("all_vehicles"),
        m.vehicles(m.ROAD_CLASSES, ("outbound",)).cast("double").alias("road_outbound"))


PCE_OF = "(coalesce(cars_{0}, 0) + coalesce(trucks_{0}, 0) * 2.5 + coalesce(trucks_with_trailer_{0}, 0) * 4.5 + coalesce(buses_{0}, 0) * 9)"


@query("P-9", f"""{W} SELECT trip_id, round({PCE_OF.format("outbound")}, 6) AS pce_outbound,
  round({PCE_OF.format("inbound")}, 6) AS pce_inbound FROM trips""")
def pce(spark, d):
    return m.with_pce(b.trips(spark, d)).select("trip_id", "pce_outbound", "pce_inbound")


@query("P-9-mismatch", f"""{W} SELECT trip_id FROM trips
  WHERE abs({PCE_OF.format("outbound")} - coalesce(passenger_car_equivalent_outbound, 0)) > 1e-6
     OR abs({PCE_OF.format("inbound")} - coalesce(passenger_car_equivalent_inbound, 0)) > 1e-6""")
def pce_mismatch(spark, d):
    return m.pce_mismatch(b.trips(spark, d)).select("trip_id")


@query("P-10", """SELECT event_id, round(value * 1.852, 6) AS kmh, round(value * 1.15078, 6) AS mph,
  round(value / 1000, 6) AS tonnes, round(value / 1852, 6) AS nm FROM events""")
def units(spark, d):
    v = F.col("value")
    return b.table(spark, d, "events").select(
        "event_id", m.to_kmh(v).alias("kmh"), m.to_mph(v).alias("mph"), m.to_tonnes(v).alias("tonnes"), m.to_nm(v).alias("nm"))


@query("P-11", f"""{W} SELECT trip_id, round(w / nullif(v, 0), 6) AS or_null,
    round(CASE WHEN v = 0 THEN CAST('inf' AS DOUBLE) ELSE w / v END, 6) AS or_inf
  FROM (SELECT trip_id, CAST({WALK} AS DOUBLE) AS w, CAST({VEH} AS DOUBLE) AS v FROM trips)""")
def guarded_division(spark, d):
    w, v = m.both("pedestrians"), m.vehicles().cast("double")
    return b.trips(spark, d).select("trip_id", m.ratio(w, v).alias("or_null"), m.ratio(w, v, "inf").alias("or_inf"))


@query("P-12", """SELECT o_orderkey, dayname(o_orderdate) AS day, monthname(o_orderdate) AS month,
  strftime(o_orderdate, '%b') AS short FROM orders""")
def labels(spark, d):
    ts = "o_orderdate"
    return b.table(spark, d, "orders").select(
        "o_orderkey", cal.day_name(ts).alias("day"), cal.month_name(ts).alias("month"), cal.month_name(ts, True).alias("short"))


@query("P-15", f"""{W} SELECT 'trip_id: ' || trip_id || ', route_name: ' || route_name || ', ferry_name: ' || ferry_name AS document,
    trip_id AS row_index, route_name AS route, ferry_name AS ferry FROM trips""")
def to_documents(spark, d):
    docs = reshape.to_documents(b.trips(spark, d), ["trip_id", "route_name", "ferry_name"], "trip_id", "route_name", "ferry_name")
    return docs.select("document", "metadata.*")


@query("F-10", f"""{W} SELECT trip_id, hour(time_departure) AS hour, isodow(time_departure) - 1 AS weekday,
    month(time_departure) AS month, year(time_departure) AS year, CAST(time_departure AS DATE) AS date,
    strftime(time_departure, '%Y-%m') AS year_month FROM trips""")
def calendar_parts(spark, d):
    ts = "time_departure"
    return b.trips(spark, d).select(
        "trip_id", F.hour(ts).alias("hour"), F.weekday(ts).alias("weekday"), F.month(ts).alias("month"),
        F.year(ts).alias("year"), F.to_date(ts).alias("date"), cal.year_month(ts).alias("year_month"))


@query("F-11", f"""{W} SELECT trip_id, round({MINUTES.format("outbound")}, 6) AS minutes,
    round({MINUTES.format("outbound")} / 60, 6) AS hours FROM trips""")
def durations(spark, d):
    s, e = "start_time_outbound", "end_time_outbound"
    return b.trips(spark, d).select(
        "trip_id", cal.minutes_between(s, e).alias("minutes"), cal.hours_between(s, e).alias("hours"))


@query("F-12", "SELECT event_id, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') AS local FROM events")
def zone(spark, d):
    # The events lie in January, when CET is one hour ahead of UTC.
    return b.table(spark, d, "events").select("event_id", cal.iso(cal.local_time("ts")).alias("local"))


# Joins and reshaping of trips


@query("J-4", f"""{W}, n AS (SELECT route_name, year(time_departure) AS year, month(time_departure) AS month,
    hour(time_departure) AS hour, count(*) AS n FROM trips GROUP BY ALL)
  SELECT s.route_name, s.year, s.month, s.hour, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT route_name, year, month, unnest(range(24)) AS hour FROM n) s LEFT JOIN n USING (route_name, year, month, hour)""")
def spine(spark, d):
    when = F.col("time_departure")
    counts = b.trips(spark, d).groupBy("route_name", F.year(when).alias("year"), F.month(when).alias("month"),
                                       F.hour(when).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return reshape.fill_range(counts, "hour", 0, 24, {"n": 0}, ["route_name", "year", "month"])


@query("J-5", f"""{W}, {b.FLEET_SQL} SELECT trip_id, n_name AS ferry_name, capacity FROM trips
  JOIN nation ON vessel_no = n_nationkey LEFT JOIN fleet ON lower(n_name) = name""")
def capacity(spark, d):
    rows = b.trips_by_vessel(spark, d).select("trip_id", "ferry_name")
    return t.with_capacity(rows, b.fleet(spark, d))


@query("R-1", f"""{W} SELECT trip_id, 'outbound' AS direction, distance_outbound_nm AS nm FROM trips
  UNION ALL SELECT trip_id, 'inbound', distance_inbound_nm FROM trips""")
def direction_rows(spark, d):
    return m.directions(b.trips(spark, d), ["trip_id"], {"nm": t.DISTANCE})


@query("U-1", f"""{W} SELECT trip_id, round(distance_outbound_nm / nullif(epoch(end_time_outbound - start_time_outbound) / 3600.0, 0), 6)
  AS knots FROM trips""")
def row_expression(spark, d):
    hours = cal.hours_between("start_time_outbound", "end_time_outbound")
    return b.trips(spark, d).select("trip_id", m.ratio(F.col("distance_outbound_nm"), hours).alias("knots"))
