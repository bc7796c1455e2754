"""Path geometry over the trips of the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.operators import paths as pt, telemetry as tm
from fairlead.plans import bindings as b
from fairlead.plans.registry import query

ALPHA, REACH, EPS = 0.3, 1_500.0, 800.0  # metres: the points of a user are kilometres apart


def trip_paths(spark, d):
    """Trips of each user as paths, numbered by their first event."""
    rows = tm.trip_points(b.points(spark, d), ["vessel_id"], stop_min=360.0)
    trips = tm.trip_paths(rows, ["vessel_id"], ["event_id"], told=("lat", "lon", "sog"))
    keyed = trips.withColumn("path_id", F.get("points", F.lit(0))["event_id"])
    return pt.as_arrays(keyed)


def _metres(a_lat, a_lon, z_lat, z_lon):
    return b.HAVERSINE_SQL.format(lat=z_lat, lon=z_lon, plat=a_lat, plon=a_lon)


def _course(z):
    """Course from the first point of a span to point z."""
    turn = f"radians(lo[{z}] - lo[a])"
    return (f"atan2(sin({turn}) * cos(radians(la[{z}])), cos(radians(la[a])) * sin(radians(la[{z}])) "
            f"- sin(radians(la[a])) * cos(radians(la[{z}])) * cos({turn}))")


# Simplified paths in SQL: a span with a point farther than the limit off its great circle is split there.
SIMPLE = f"""WITH RECURSIVE {b.segments_sql("vessel_id", 21600)},
  raw AS (SELECT min(event_id) AS path_id, list(lat ORDER BY time) AS la, list(lon ORDER BY time) AS lo
    FROM segments GROUP BY vessel_id, trip_no HAVING count(*) > 1),
  spans AS (
    SELECT path_id, la, lo, 1::BIGINT AS a, len(la)::BIGINT AS b FROM raw
    UNION ALL SELECT path_id, la, lo, unnest([a, m]) AS a, unnest([m, b]) AS b FROM (
      SELECT path_id, la, lo, a, b, a + list_position(far, list_max(far)) AS m, list_max(far) AS most FROM (
        SELECT *, list_transform(range(a + 1, b), lambda i: abs(asin(sin({_metres("la[a]", "lo[a]", "la[i]", "lo[i]")} / 6371000)
          * sin({_course("b")} - {_course("i")}))) * 6371000) AS far FROM spans WHERE b - a >= 2)) WHERE most > 1000),
  kept AS (SELECT DISTINCT path_id, i FROM (SELECT path_id, unnest([a, b]) AS i FROM spans)),
  simple AS (SELECT path_id, list(la[i] ORDER BY i) AS la, list(lo[i] ORDER BY i) AS lo FROM kept JOIN raw USING (path_id) GROUP BY path_id)"""

# Their distances: the table of the discrete Frechet distance, one cell per round for all pairs whose ends are near.
DISTANCES = f"""{SIMPLE},
  turned AS (SELECT *, atan2(lo[-1] - lo[1], la[-1] - la[1]) AS dir FROM simple),
  near AS (SELECT x.path_id AS i, y.path_id AS j, x.la AS la1, x.lo AS lo1, y.la AS la2, y.lo AS lo2, len(x.la) AS n1, len(y.la) AS n2,
      abs(x.dir - y.dir) AS turn FROM turned x JOIN turned y ON x.path_id < y.path_id
    WHERE {_metres("x.la[1]", "x.lo[1]", "y.la[1]", "y.lo[1]")} <= {REACH / (1 - ALPHA) + 1}
      AND {_metres("x.la[-1]", "x.lo[-1]", "y.la[-1]", "y.lo[-1]")} <= {REACH / (1 - ALPHA) + 1}),
  cells AS (
    SELECT *, 0::BIGINT AS k, []::DOUBLE[] AS f FROM near
    UNION ALL SELECT i, j, la1, lo1, la2, lo2, n1, n2, turn, k + 1, list_append(f, greatest(
      {_metres("la1[k // n2 + 1]", "lo1[k // n2 + 1]", "la2[k % n2 + 1]", "lo2[k % n2 + 1]")},
      CASE WHEN k = 0 THEN 0 WHEN k < n2 THEN f[k] WHEN k % n2 = 0 THEN f[k - n2 + 1]
        ELSE least(f[k], f[k - n2 + 1], f[k - n2]) END)) FROM cells WHERE k < n1 * n2),
  distances AS (SELECT i, j, {1 - ALPHA} * f[k] + {ALPHA} * turn AS dist FROM cells WHERE k = n1 * n2)"""


@query("G-7", f"""{SIMPLE} SELECT path_id, len(la) AS n_points, round(list_sum(list_transform(range(1, len(la)),
    lambda i: {_metres("la[i]", "lo[i]", "la[i + 1]", "lo[i + 1]")})), 4) AS metres FROM simple""", digits=4)
def simplify(spark, d):
    rows = pt.simplify(trip_paths(spark, d), 1_000.0)
    return rows.select("path_id", F.size("lat").alias("n_points"), geo.path_length(F.arrays_zip("lat", "lon")).alias("metres"))


@query("G-8", f"{DISTANCES} SELECT i, j, round(dist, 4) AS dist FROM distances WHERE dist <= {REACH}", digits=4)
def path_distances(spark, d):
    return pt.path_distances(pt.simplify(trip_paths(spark, d), 1_000.0), ALPHA, REACH)


# The start-and-end bound that blocks G-8, against the full pairing in SQL: two-point trips
# have a Frechet distance equal to the larger of their end gaps.
@query("J-11", f"""WITH {b.segments_sql("vessel_id", 21600)},
  ends AS (SELECT min(event_id) AS path_id, arg_min(lat, time) AS a_lat, arg_min(lon, time) AS a_lon, arg_max(lat, time) AS z_lat,
      arg_max(lon, time) AS z_lon FROM segments GROUP BY vessel_id, trip_no HAVING count(*) > 1),
  d AS (SELECT i.path_id AS i, j.path_id AS j, greatest(
      {b.HAVERSINE_SQL.format(lat="i.a_lat", lon="i.a_lon", plat="j.a_lat", plon="j.a_lon")},
      {b.HAVERSINE_SQL.format(lat="i.z_lat", lon="i.z_lon", plat="j.z_lat", plon="j.z_lon")}) * 0.7
      + 0.3 * abs(atan2(i.z_lon - i.a_lon, i.z_lat - i.a_lat) - atan2(j.z_lon - j.a_lon, j.z_lat - j.a_lat)) AS dist
    FROM ends i JOIN ends j ON i.path_id < j.path_id)
  SELECT i, j, round(dist, 4) AS dist FROM d WHERE dist <= {REACH}""", digits=4)
def end_distances(spark, d):
    paths = trip_paths(spark, d)
    ends = paths.select("path_id", *[F.array(F.get(c, F.lit(0)), F.element_at(c, -1)).alias(c) for c in ("lat", "lon")])
    return pt.path_distances(ends, ALPHA, REACH)


# With two samples to a core every path that has a neighbour is one, and clusters are the components of the near pairs.
@query("G-9", f"""{DISTANCES},
  links AS (SELECT i AS a, j AS b FROM distances WHERE dist <= {EPS} UNION ALL SELECT j, i FROM distances WHERE dist <= {EPS}),
  reached AS (SELECT DISTINCT a AS node, a AS root FROM links UNION SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.node),
  parts AS (SELECT node, min(root) AS part FROM reached GROUP BY node)
  SELECT path_id, coalesce(dense_rank() OVER (PARTITION BY part IS NULL ORDER BY part) - 1 + CASE WHEN part IS NULL THEN -1 ELSE 0 END, -1) AS label
  FROM raw LEFT JOIN parts ON path_id = node""")
def cluster_paths(spark, d):
    return pt.cluster_paths(trip_paths(spark, d), ALPHA, EPS, 2, 1_000.0)


@query("G-10")
def representative_path(spark, d):
    paths = trip_paths(spark, d)
    labels = pt.cluster_paths(paths, ALPHA, EPS, 2, 1_000.0)
    return pt.representative_path(paths.join(labels.filter(F.col("label") >= 0), "path_id"), "label", 1_000.0)


TRACKS = f"""{b.segments_sql("vessel_id", 21600)}, tracks AS (SELECT min(event_id) AS path_id, count(*) AS n,
  arg_min(lon, time) AS first_lon, arg_min(lat, time) AS first_lat FROM segments GROUP BY vessel_id, trip_no HAVING count(*) > 1)"""


@query("G-12", f"""WITH {TRACKS}, c AS (SELECT *, (row_number() OVER (ORDER BY path_id) - 1) % 30 AS k FROM tracks)
  SELECT path_id, n AS n_points, round(first_lon, 6) AS first_lon,
    [{", ".join(str(r) for r, _, _ in geo.CLUSTER_COLORS)}][k + 1] AS red FROM c""")
def map_rows(spark, d):
    rows = pt.map_rows(trip_paths(spark, d))
    return rows.select("path_id", F.size("path").alias("n_points"), F.get(F.get("path", F.lit(0)), F.lit(0)).alias("first_lon"),
                       F.get("color", F.lit(0)).alias("red"))


@query("F-16", f"""SELECT event_id, user_id % 37 - 1 AS label, round(18 + event_id % 991 / 1000.0, 6) AS lon,
    CASE WHEN user_id % 37 = 0 THEN 255 ELSE [{", ".join(str(g) for _, g, _ in geo.CLUSTER_COLORS)}][(user_id % 37 - 1) % 30 + 1] END AS green
  FROM events""")
def flip(spark, d):
    rows = b.points(spark, d).withColumn("label", F.col("vessel_id").cast("long") % 37 - 1)
    flipped = geo.flip(F.array(F.struct("lat", "lon")))
    return rows.select("event_id", "label", F.get(F.get(flipped, F.lit(0)), F.lit(0)).alias("lon"),
                       F.get(geo.color(F.col("label")), F.lit(1)).alias("green"))


# Grouped path functions in their Arrow form: lengths of whole paths against summed steps.
@query("U-4", f"""WITH {b.segments_sql("vessel_id", 21600)} SELECT min(event_id) AS path_id, round(sum(step_m), 4) AS metres
  FROM segments GROUP BY vessel_id, trip_no HAVING count(*) > 1""", digits=4)
def path_lengths(spark, d):
    rows = trip_paths(spark, d)
    return rows.select("path_id", geo.path_length(F.arrays_zip("lat", "lon")).alias("metres"))
