"""Telemetry, as-of joins, segmentation, geometry and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.operators import asof, telemetry as tm, windows
from fairlead.operators.reshape import pivot_telemetry
from fairlead.plans import bindings as b
from fairlead.plans.registry import query
from fairlead.session import scratch
from fairlead.sources import sinks
from fairlead.streaming import stream

SIX_HOURS = 360.0  # minutes: events of one user are hours apart
PARAMS = ["click", "error", "purchase", "signup", "view"]
H = b.HAVERSINE_SQL.format(lat="lat", lon="lon", plat="plat", plon="plon")
PREVIOUS = """prev AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(lat, 2) OVER w AS slat, lag(lon, 2) OVER w AS slon
  FROM (SELECT event_id, user_id, 59 + event_id % 997 / 1000.0 AS lat, 18 + event_id % 991 / 1000.0 AS lon, ts FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY ts))"""


def _neighbours(spark, d):
    """Each point with the two before it."""
    points = b.points(spark, d).withColumnRenamed("vessel_id", "user_id")
    one = windows.with_previous(points, ["user_id"], "time", {"lat": "plat", "lon": "plon"})
    return windows.with_previous(one, ["user_id"], "time", {"plat": "slat", "plon": "slon"})


SELECTED = """SELECT event_id, epoch_us(ts) AS t FROM events WHERE user_id = 8 AND ts >= TIMESTAMP '2024-01-03'
  AND ts < TIMESTAMP '2024-01-20' AND (event_type ILIKE '%lic%' OR event_type ILIKE '%ERR%')"""


@query("S-12", SELECTED)
def telemetry_select(spark, d):
    rows = tm.telemetry_select(b.event_telemetry(spark, d), "8", "2024-01-03T00:00:00", "2024-01-20T00:00:00", ["lic", "ERR"])
    return rows.select("event_id", F.unix_micros(F.col("time").cast("timestamp")).alias("t"))


# Written in the layout by day and vessel first, and selected from there.
@query("S-12-layout", SELECTED)
def telemetry_layout(spark, d):
    folder = scratch(spark, "telemetry")
    sinks.write_telemetry(b.event_telemetry(spark, d), folder)
    rows = tm.telemetry_select(spark.read.parquet(folder), "8", "2024-01-03T00:00:00", "2024-01-20T00:00:00", ["lic", "ERR"])
    return rows.select("event_id", F.unix_micros(F.col("time").cast("timestamp")).alias("t"))


@query("S-12-bucket", """SELECT event_type AS parameter_id, time_bucket(INTERVAL 10 MINUTE, ts) AS bucket, round(avg(value), 6) AS avg_value
  FROM events WHERE user_id = 8 AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2""")
def telemetry_buckets(spark, d):
    rows = tm.telemetry_select(
        b.event_telemetry(spark, d), "8", "2024-01-03T00:00:00", "2024-01-20T00:00:00", ["*"], "10 minutes")
    return rows.select("parameter_id", "bucket", "avg_value")


@query("R-3", f"""SELECT CAST(user_id AS VARCHAR) AS vessel_id, ts AS time,
  {", ".join(f"arg_min(value, event_id) FILTER (event_type = '{p}') AS {p}" for p in PARAMS)} FROM events GROUP BY 1, 2""")
def pivot(spark, d):
    return pivot_telemetry(b.event_telemetry(spark, d), PARAMS, ["vessel_id", "time"], tiebreak="event_id")


@query("ST-1", """SELECT CAST(user_id AS VARCHAR) AS vessel_id, time_bucket(INTERVAL 10 MINUTE, ts) AS bucket, event_type AS parameter_id,
    round(avg(value), 6) AS avg_value, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def bucket_average(spark, d):
    rows = b.event_telemetry(spark, d)
    # The mean time is checked in the unit tests; the count joins from the same windows here.
    counts = rows.groupBy("vessel_id", F.window("time", "10 minutes").alias("w"), "parameter_id").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("vessel_id", F.col("w.start").alias("bucket"), "parameter_id", "n")
    keys = ["vessel_id", "bucket", "parameter_id"]
    return stream.bucket_average(rows, "10 minutes").drop("avg_time").join(counts, keys)


@query("ST-2", f"""WITH {b.segments_sql("vessel_id", 21600)} SELECT vessel_id, min(time) AS start_time, max(time) AS end_time,
    count(*) AS n_points FROM segments GROUP BY vessel_id, trip_no HAVING count(*) > 1""")
def trip_sessions(spark, d):
    return stream.trip_sessions(b.points(spark, d), "6 hours")


@query("W-1", """SELECT event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6, 6) AS dt
  FROM events""")
def lag_seconds(spark, d):
    rows = b.table(spark, d, "events").select("event_id", "user_id", "ts")
    return windows.lag_seconds(rows, ["user_id"], "ts", tiebreak=["event_id"]).select("event_id", "dt")


@query("W-2", """SELECT event_id, CAST(sum(CASE WHEN gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trip_no
  FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)""")
def segment(spark, d):
    rows = b.table(spark, d, "events").select("event_id", "user_id", "ts")
    return windows.segment(rows, ["user_id"], "ts", SIX_HOURS * 60, tiebreak=["event_id"]).select("event_id", "trip_no")


@query("W-3", """SELECT event_id, coalesce(lead(event_id) OVER w, event_id) AS next_id FROM events
  WINDOW w AS (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id)""")
def next_row(spark, d):
    rows = b.table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    return asof.with_next(rows, ["user_id", "day"], ["ts", "event_id"], {"event_id": "next_id"}).select("event_id", "next_id")


@query("W-4", """SELECT user_id, event_id, event_type, value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1""")
def argmax(spark, d):
    rows = b.table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return windows.argmax(rows, ["user_id"], "value", ["event_id"])


@query("J-6", """WITH l AS (SELECT event_id AS trip_id, user_id, ts + INTERVAL 37 MINUTE AS t FROM events),
  c AS (SELECT trip_id, event_id, value, abs(epoch_us(e.ts) - epoch_us(l.t)) AS gap, e.ts FROM l JOIN events e USING (user_id)
    WHERE abs(epoch_us(e.ts) - epoch_us(l.t)) <= 3600000000
    QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY abs(epoch_us(e.ts) - epoch_us(l.t)), e.ts, event_id) = 1)
  SELECT trip_id, c.event_id AS matched_id, c.value AS matched_value, round(gap / 1e6, 6) AS gap_seconds
  FROM l LEFT JOIN c USING (trip_id)""")
def asof_nearest(spark, d):
    events = b.table(spark, d, "events")
    minute = F.make_dt_interval(mins=F.lit(37))
    left = events.select(F.col("event_id").alias("trip_id"), "user_id", (F.col("ts") + minute).alias("t"))
    right = events.select("user_id", F.col("event_id").alias("matched_id"), F.col("value").alias("matched_value"), "ts")
    rows = asof.asof_nearest(left, right, ["user_id"], "t", "ts", 3600, ["matched_id", "matched_value"], "matched_id")
    return rows.select("trip_id", "matched_id", "matched_value", "gap_seconds")


@query("J-7", f"""WITH {b.segments_sql("vessel_id, day", 3600)} SELECT vessel_id, day, trip_no, start_time, end_time,
    coalesce(lead(trip_no) OVER w, trip_no) AS inbound_trip_no, coalesce(lead(start_time) OVER w, start_time) AS inbound_start_time,
    coalesce(lead(end_time) OVER w, end_time) AS inbound_end_time
  FROM trip_table WINDOW w AS (PARTITION BY vessel_id, day ORDER BY start_time, trip_no)""")
def pair_inbound(spark, d):
    table = _day_trips(spark, d).drop("n_points", "distance_nm", "fuel_l")
    return asof.pair_inbound(table, ["vessel_id", "day"])


def _day_trips(spark, d):
    from fairlead.functions.calendar import local_time
    points = b.points(spark, d).withColumn("day", F.to_date(local_time("time")))
    rows = tm.trip_points(points, ["vessel_id", "day"], "time", 1.0, 60.0, bounded=True)
    return tm.trip_table(rows, ["vessel_id", "day"], ["engine_1_fuelcons_lph"])


@query("J-8", """SELECT o_orderkey, o_orderpriority, o_orderdate, m.price AS o_totalprice FROM orders
  LEFT JOIN (SELECT o_orderpriority, o_orderdate, arg_max(o_totalprice, o_orderkey) AS price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) m
  USING (o_orderpriority, o_orderdate)""")
def write_back(spark, d):
    orders = b.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderstatus")
    keys = ["o_orderpriority", "o_orderdate"]
    matched = orders.filter(F.col("o_orderstatus") == "F")
    return tm.write_back(orders.drop("o_orderstatus"), matched, keys, ["o_totalprice"], ["o_orderkey"])


@query("J-13", """WITH t AS (SELECT o_orderkey, o_orderpriority, o_orderkey % 1440 AS minute FROM orders),
  s AS (SELECT DISTINCT o_orderpriority, CAST(minute // 60 * 3600 AS DOUBLE) AS slot FROM t),
  a AS (SELECT o_orderpriority, slot, unnest([slot - 86400, slot, slot + 86400]) AS moment FROM s)
  SELECT o_orderkey, arg_min(slot, moment) AS slot, count(slot) = 0 AS doubtful FROM t
  LEFT JOIN a ON a.o_orderpriority = t.o_orderpriority AND abs(minute * 60 - moment) <= 300 GROUP BY 1""")
def match_timetable(spark, d):
    minute = F.col("o_orderkey") % 1440
    trips = b.table(spark, d, "orders").select(
        "o_orderkey", "o_orderpriority", (F.col("o_orderdate") + F.make_dt_interval(mins=minute.cast("int"))).alias("t"))
    slots = trips.select("o_orderpriority", (F.hour("t") * 3600).cast("double").alias("slot"))
    return asof.match_timetable(trips, slots, "o_orderpriority", "t", "slot").select("o_orderkey", "slot", "doubtful")


@query("G-1", f"""WITH {b.segments_sql("vessel_id", 21600)} SELECT vessel_id, trip_no, count(*) AS n_points,
    strftime(min(local_time), '%Y-%m-%dT%H:%M:%S') AS first_time, round(arg_min(lat, time), 6) AS first_lat,
    round(arg_max(lon, time), 6) AS last_lon, round(sum(fuel), 6) AS fuel FROM segments GROUP BY 1, 2 HAVING count(*) > 1""")
def trips_from_telemetry(spark, d):
    fuel = ["engine_1_fuelcons_lph"]
    trips = tm.trips_from_telemetry(
        b.readings(spark, d), stop_min=SIX_HOURS, fuel=fuel, tiebreak="event_id")
    points = F.col("points")
    total = F.aggregate(points, F.lit(0.0), lambda s, p: s + p[fuel[0]])
    return trips.select(
        "vessel_id", "trip_no", F.size(points).alias("n_points"),
        F.date_format(F.get(points, F.lit(0))["local_time"], "yyyy-MM-dd'T'HH:mm:ss").alias("first_time"),
        F.get(points, F.lit(0))["lat"].alias("first_lat"), F.element_at(points, -1)["lon"].alias("last_lon"), total.alias("fuel"))


@query("G-2", f"WITH {PREVIOUS} SELECT event_id, round({H}, 4) AS metres FROM prev", digits=4)
def haversine(spark, d):
    step = geo.haversine(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))
    return _neighbours(spark, d).select("event_id", step.alias("metres"))


def _bearing(a, o, c, p):
    return f"""((degrees(atan2(sin(radians({p} - {o})) * cos(radians({c})), cos(radians({a})) * sin(radians({c}))
      - sin(radians({a})) * cos(radians({c})) * cos(radians({p} - {o})))) + 360) % 360)"""


@query("G-3", f"WITH {PREVIOUS} SELECT event_id, round({_bearing('plat', 'plon', 'lat', 'lon')}, 6) AS degrees FROM prev")
def bearing(spark, d):
    return _neighbours(spark, d).select(
        "event_id", geo.bearing(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")).alias("degrees"))


ARC = b.HAVERSINE_SQL.format(lat="lat", lon="lon", plat="slat", plon="slon")


@query("G-4", f"""WITH {PREVIOUS} SELECT event_id, round(asin(sin({ARC} / 6371000) * sin(radians({_bearing('slat', 'slon', 'plat', 'plon')})
    - radians({_bearing('slat', 'slon', 'lat', 'lon')}))) * 6371000, 4) AS metres FROM prev""", digits=4)
def cross_track(spark, d):
    at = lambda a, o: (F.col(a), F.col(o))
    metres = geo.cross_track(at("slat", "slon"), at("plat", "plon"), at("lat", "lon"))
    return _neighbours(spark, d).select("event_id", metres.alias("metres"))


@query("G-5", f"""WITH {b.segments_sql("vessel_id", 21600)} SELECT vessel_id, trip_no, n_points, round(distance_nm, 6) AS distance_nm
  FROM trip_table""")
def trip_distance(spark, d):
    rows = tm.trip_points(b.points(spark, d), ["vessel_id"], stop_min=SIX_HOURS)
    return tm.trip_table(rows, ["vessel_id"]).select("vessel_id", "trip_no", "n_points", "distance_nm")


@query("G-6", f"WITH {b.segments_sql('vessel_id', 21600)} SELECT vessel_id, trip_no, round(fuel_l, 6) AS fuel_l FROM trip_table")
def fuel_integral(spark, d):
    rows = tm.trip_points(b.points(spark, d), ["vessel_id"], stop_min=SIX_HOURS)
    return tm.trip_table(rows, ["vessel_id"], ["engine_1_fuelcons_lph"]).select("vessel_id", "trip_no", "fuel_l")


@query("G-11", f"""WITH {b.segments_sql("vessel_id, day", 3600)},
  rounds AS (SELECT *, coalesce(lead(fuel_l) OVER w, fuel_l) AS fuel_in, coalesce(lead(distance_nm) OVER w, distance_nm) AS nm_in,
      coalesce(lead(start_time) OVER w, start_time) AS start_in, coalesce(lead(end_time) OVER w, end_time) AS end_in
    FROM trip_table WINDOW w AS (PARTITION BY vessel_id, day ORDER BY start_time, trip_no)),
  l AS (SELECT event_id AS trip_id, 'Vessel' || user_id AS ferry_name, CAST(user_id AS VARCHAR) AS vessel_id,
      ts + INTERVAL 37 MINUTE AS time_departure FROM events),
  near AS (SELECT trip_id, r.* FROM l JOIN rounds r ON r.vessel_id = l.vessel_id AND r.day = CAST(time_departure AS DATE)
    WHERE abs(epoch_us(start_time) - epoch_us(time_departure)) <= 10800000000
    QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY abs(epoch_us(start_time) - epoch_us(time_departure)), start_time, trip_no) = 1)
  SELECT l.trip_id, ferry_name, time_departure, round(fuel_l, 6) AS fuelcons_outbound_l, round(distance_nm, 6) AS distance_outbound_nm,
    start_time AS start_time_outbound, end_time AS end_time_outbound, round(fuel_in, 6) AS fuelcons_inbound_l,
    round(nm_in, 6) AS distance_inbound_nm, start_in AS start_time_inbound, end_in AS end_time_inbound
  FROM l LEFT JOIN near USING (trip_id)""")
def enrich_trips(spark, d):
    return tm.enrich_trips(
        b.departures(spark, d), b.vessel_names(spark, d), b.readings(spark, d), tolerance_min=180.0, stop_min=60.0,
        fuel=["engine_1_fuelcons_lph"], tiebreak="event_id")
