"""The driver tables in the shapes the operators take, as DataFrames and as SQL.

The SQL text is written on its own and only the checks use it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.calendar import period
from fairlead.operators import warehouse
from fairlead.session import short_batches, spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crossings(lines: DataFrame) -> DataFrame:
    """Line items as one row per order with measures for odd and even lines."""
    weight = "CASE l_returnflag WHEN 'A' THEN 1.0D WHEN 'N' THEN 2.5D ELSE 4.5D END"
    aggs = []
    for side, odd in (("outbound", 1), ("inbound", 0)):
        measures = {
            f"cars_{side}": ("l_quantity", "l_returnflag = 'A'"),
            f"trucks_{side}": ("l_quantity", "l_returnflag = 'N'"),
            f"trucks_with_trailer_{side}": ("l_quantity", "l_returnflag = 'R'"),
            f"motorcycles_{side}": ("l_linenumber", "l_linestatus = 'O'"),
            f"buses_{side}": ("l_suppkey % 3", "true"),
            f"pedestrians_{side}": ("l_partkey % 7", "true"),
            f"vehicles_left_at_terminal_{side}": ("l_partkey % 5", "l_linestatus = 'F'"),
            f"passenger_car_equivalent_{side}": (f"l_quantity * {weight}", "true"),
            f"distance_{side}_nm": ("l_quantity", "true"),
        }
        here = f"l_linenumber % 2 = {odd}"
        aggs += [F.expr(f"sum(CASE WHEN {here} AND {cond} THEN {value} END) AS {name}")
                 for name, (value, cond) in measures.items()]
        aggs += [
            F.expr(f"sum(CASE WHEN {here} THEN l_extendedprice END) / 1000 AS fuelcons_{side}_l"),
            F.expr(f"min(CASE WHEN {here} THEN l_shipdate END) AS start_time_{side}"),
            F.expr(f"max(CASE WHEN {here} THEN l_shipdate END) AS end_time_{side}"),
        ]
    return lines.groupBy("l_orderkey").agg(*aggs)


def trips(spark: SparkSession, folder: str, year: int | None = None, month: int | None = None) -> DataFrame:
    """The wide trip table. A year, or a month of it, is a range on the stored date, so the scan prunes by
    statistics, and only the lines of its orders are aggregated.
    """
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    lines = table(spark, folder, "lineitem")
    if year is not None:
        low, high = (F.lit(v).cast(orders.schema["o_orderdate"].dataType) for v in period(year, month))
        orders = orders.filter((F.col("o_orderdate") >= low) & (F.col("o_orderdate") < high))
        lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    minute = F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    heads = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("trip_id"), F.col("o_orderpriority").alias("route_name"),
        F.col("c_mktsegment").alias("ferry_name"), F.col("c_nationkey").alias("vessel_no"),
        F.col("o_orderstatus").alias("trip_type"), (F.col("o_orderdate") + minute).alias("time_departure"),
    )
    return heads.join(crossings(lines), F.col("trip_id") == F.col("l_orderkey"), "left").drop("l_orderkey")


def trips_by_vessel(spark: SparkSession, folder: str) -> DataFrame:
    """The trips with the nation as the ferry, which the fleet table knows."""
    names = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("vessel_no"), F.col("n_name").alias("ferry_name")
    )
    return trips(spark, folder).drop("ferry_name").join(names, "vessel_no")


def fleet(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as ferries, every seventh without a capacity."""
    key = F.col("n_nationkey")
    return table(spark, folder, "nation").select(
        F.lower("n_name").alias("name"),
        F.when(key % 7 != 0, (key * 10 + 1).cast("double")).alias("capacity_passenger_car_equivalent"),
    )


def vessels(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as ferries with up to two engines and up to three propulsion units."""
    key = F.col("s_suppkey")
    engines = F.transform(
        F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), (key % 3).cast("int")),
        lambda i: F.struct(F.concat(F.lit("engine"), i.cast("string")).alias("type"),
                           (F.lit(1970) + (key + i) % 50).cast("int").alias("year_manufactured")),
    )
    drives = F.transform(
        F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), (key % 4).cast("int")),
        lambda i: F.struct(F.concat(F.lit("drive"), ((key + i) % 5).cast("string")).alias("type"),
                           (F.lit(1980) + (key + i) % 40).cast("int").alias("year_manufactured")),
    )
    return table(spark, folder, "supplier").select(
        F.lower("s_name").alias("name"),
        F.when(key % 7 != 0, (key % 90 + 10).cast("double")).alias("capacity_passenger_car_equivalent"),
        F.col("s_acctbal").alias("installed_power_kw"), (key % 60 + 20).cast("double").alias("length_over_all_m"),
        (key % 5 + 8).cast("double").alias("breadth_m"),
        F.struct(engines.alias("engines"), drives.alias("propulsion")).alias("machinery"),
    )


_SIDE = """
    sum(CASE WHEN {c} AND l_returnflag = 'A' THEN l_quantity END) AS cars_{d},
    sum(CASE WHEN {c} AND l_returnflag = 'N' THEN l_quantity END) AS trucks_{d},
    sum(CASE WHEN {c} AND l_returnflag = 'R' THEN l_quantity END) AS trucks_with_trailer_{d},
    sum(CASE WHEN {c} AND l_linestatus = 'O' THEN l_linenumber END) AS motorcycles_{d},
    sum(CASE WHEN {c} THEN l_suppkey % 3 END) AS buses_{d},
    sum(CASE WHEN {c} THEN l_partkey % 7 END) AS pedestrians_{d},
    sum(CASE WHEN {c} AND l_linestatus = 'F' THEN l_partkey % 5 END) AS vehicles_left_at_terminal_{d},
    sum(CASE WHEN {c} THEN l_quantity * CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 2.5 ELSE 4.5 END END)
        AS passenger_car_equivalent_{d},
    sum(CASE WHEN {c} THEN l_extendedprice END) / 1000 AS fuelcons_{d}_l,
    sum(CASE WHEN {c} THEN l_quantity END) AS distance_{d}_nm,
    min(CASE WHEN {c} THEN l_shipdate END) AS start_time_{d},
    max(CASE WHEN {c} THEN l_shipdate END) AS end_time_{d}"""

TRIPS_SQL = f"""
crossings AS (
  SELECT l_orderkey,{_SIDE.format(c="l_linenumber % 2 = 1", d="outbound")},{_SIDE.format(c="l_linenumber % 2 = 0", d="inbound")}
  FROM lineitem GROUP BY l_orderkey),
trips AS (
  SELECT o_orderkey AS trip_id, o_orderpriority AS route_name, c_mktsegment AS ferry_name, c_nationkey AS vessel_no,
         o_orderstatus AS trip_type, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS time_departure,
         crossings.* EXCLUDE (l_orderkey)
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN crossings ON o_orderkey = l_orderkey)"""

FLEET_SQL = """
fleet AS (
  SELECT lower(n_name) AS name, CASE WHEN n_nationkey % 7 <> 0 THEN CAST(n_nationkey * 10 + 1 AS DOUBLE) END AS capacity
  FROM nation)"""

VESSELS_SQL = """
units AS (SELECT s_suppkey, i FROM supplier, (SELECT unnest([0, 1, 2]) AS i)),
engines AS (SELECT s_suppkey, 1970 + (s_suppkey + i) % 50 AS made FROM units WHERE i < s_suppkey % 3 AND i < 2),
drives AS (SELECT s_suppkey, 'drive' || ((s_suppkey + i) % 5) AS type, 1980 + (s_suppkey + i) % 40 AS made
           FROM units WHERE i < s_suppkey % 4)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; whole counts as long integers."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append(F.round(F.col(name).cast("double"), digits).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


# Evaluation store: sources as models, documents as results, labels as evaluations.

SCORE_WIDTHS = {"faithfulness": 11, "bleu_score": 13, "non_llm_string_similarity": 17, "rogue_score": 19}


def store(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    number = F.regexp_extract("source", r"\d+", 0).cast("int")
    chars = F.col("n_chars")
    kind = F.when(F.col("id") % 2 == 0, "proprietary").otherwise("open source")
    models = docs.select(number.alias("id"), F.col("source").alias("name")).distinct().withColumn("type", kind)
    results = docs.select(
        F.col("doc_id").alias("id"), number.alias("llm_model_id"),
        F.concat("lang", F.lit("/"), (F.floor(F.col("doc_id") / 20) % 3).cast("string")).alias("query"),
        F.col("text").alias("direct_response"), F.col("text").alias("full_response"),
        F.concat(F.lit('["SELECT '), F.col("doc_id").cast("string"), F.lit('"]')).alias("sql_queries"),
        (F.col("doc_id") % 20).cast("int").alias("test_no"), F.lit("run_query").alias("tool_calls"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int")))
        .alias("timestamp"),
    )
    scored = labels.join(docs.select("doc_id", "n_chars"), "doc_id")
    metrics = scored.select(
        F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("factual_correctness"),
        (chars % 101 / 100).alias("semantic_similarity"),
        F.when(F.col("toxic") == 0, chars % 7 / 6).alias("context_recall"),
        *[(chars % w / (w - 1)).alias(n) for n, w in SCORE_WIDTHS.items()],
        F.col("toxic").cast("double").alias("string_present"),
    )
    evaluations = labels.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("query_result_id"),
        F.col("doc_id").alias("evaluation_metrics_id"), F.lit("[]").alias("retrieved_contexts"),
        F.lit("truth").alias("ground_truth"),
    )
    copies = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = docs.filter(F.col("doc_id") % 5 != 0).select("doc_id", "n_chars", F.explode(copies).alias("copy"))
    tokens = rows.select(
        (F.col("doc_id") * 2 + F.col("copy")).alias("id"), F.col("doc_id").alias("query_result_id"),
        chars.cast("double").alias("prompt_tokens"), (chars % 1000).cast("double").alias("completion_tokens"),
        (chars + chars % 1000).cast("double").alias("total_tokens"),
    )
    return {"llm_models": models, "query_result": results, "query_evaluation": evaluations,
            "evaluation_metrics": metrics, "token_usage": tokens}


STORE_SQL = """
llm_models AS (
  SELECT DISTINCT CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS id, source AS name,
         CASE WHEN CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 2 = 0 THEN 'proprietary' ELSE 'open source' END AS type
  FROM documents),
query_result AS (
  SELECT doc_id AS id, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS llm_model_id,
         lang || '/' || ((doc_id // 20) % 3) AS query, text AS direct_response, text AS full_response,
         '["SELECT ' || doc_id || '"]' AS sql_queries, doc_id % 20 AS test_no, 'run_query' AS tool_calls,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS timestamp
  FROM documents),
query_evaluation AS (
  SELECT doc_id AS id, doc_id AS query_result_id, doc_id AS evaluation_metrics_id, '[]' AS retrieved_contexts,
         'truth' AS ground_truth FROM labels),
evaluation_metrics AS (
  SELECT doc_id AS id, CAST(quality AS DOUBLE) AS factual_correctness, n_chars % 101 / 100 AS semantic_similarity,
         CASE WHEN toxic = 0 THEN n_chars % 7 / 6 END AS context_recall, n_chars % 11 / 10 AS faithfulness,
         n_chars % 13 / 12 AS bleu_score, n_chars % 17 / 16 AS non_llm_string_similarity,
         n_chars % 19 / 18 AS rogue_score, CAST(toxic AS DOUBLE) AS string_present
  FROM labels JOIN documents USING (doc_id)),
token_usage AS (
  SELECT doc_id * 2 + i AS id, doc_id AS query_result_id, CAST(n_chars AS DOUBLE) AS prompt_tokens,
         CAST(n_chars % 1000 AS DOUBLE) AS completion_tokens, CAST(n_chars + n_chars % 1000 AS DOUBLE) AS total_tokens
  FROM documents, (SELECT unnest([0, 1]) AS i) WHERE doc_id % 5 <> 0 AND (i = 0 OR doc_id % 7 = 0))"""


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    return as_attempts(table(spark, folder, "events"))


def as_attempts(events: DataFrame) -> DataFrame:
    """Events as an attempt log: event type as model, user as test."""
    value = F.col("value")
    status = (
        F.when(value < 5, "pending").when(value < 10, "running").when(value < 30, "failed")
        .when(value < 60, "max_retries_reached").otherwise("success")
    )
    return events.select(
        F.col("event_type").alias("model_id"), F.col("user_id").alias("test_case_id"),
        (F.col("event_id") % 3).cast("int").alias("run_number"), status.alias("attempt_status"),
        (F.col("event_id") % 4).cast("int").alias("retry_count"), F.col("ts").alias("attempt_ts"), "event_id",
    )


ATTEMPTS_SQL = """
attempts AS (
  SELECT event_type AS model_id, user_id AS test_case_id, event_id % 3 AS run_number,
         CASE WHEN value < 5 THEN 'pending' WHEN value < 10 THEN 'running' WHEN value < 30 THEN 'failed'
              WHEN value < 60 THEN 'max_retries_reached' ELSE 'success' END AS attempt_status,
         event_id % 4 AS retry_count, ts AS attempt_ts, event_id
  FROM events),
last AS (SELECT * FROM attempts
         QUALIFY row_number() OVER (PARTITION BY model_id, test_case_id, run_number ORDER BY attempt_ts DESC) = 1)"""


# An event is a run of its own here: users are the cases, and a model's busiest user sets the runs of each.
PROGRESS_SQL = f"""WITH {ATTEMPTS_SQL.split(",\nlast AS")[0]},
  plan AS (SELECT model_id, count(*) * max(n) AS total FROM (
    SELECT event_type AS model_id, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1)
  SELECT model_id, count(*) FILTER (attempt_status IN ('success', 'max_retries_reached')) AS done,
    CAST(sum(retry_count) AS BIGINT) AS retries, any_value(total) AS total,
    CAST(floor(count(*) FILTER (attempt_status IN ('success', 'max_retries_reached')) / any_value(total) * 100) AS BIGINT) AS percent
  FROM attempts JOIN plan USING (model_id) GROUP BY 1"""


def planned_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(model_id, total) for the attempt log."""
    cases = table(spark, folder, "events").groupBy(
        F.col("event_type").alias("model_id"), F.col("user_id").alias("test_case_id")).agg(F.count(F.lit(1)).alias("runs"))
    return warehouse.run_plan(cases, F.col("runs"))


# Answers, dialogues, telemetry.


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Each document answers one benchmark item, whose text is the reference."""
    short_batches(spark)
    items = table(spark, folder, "benchmark")
    n = items.count()
    refs = items.select(F.col("item_id").alias("_item"), F.col("text").alias("reference"))
    docs = spread(table(spark, folder, "documents")).select(
        F.col("doc_id").alias("query_result_id"), "source", F.col("text").alias("response"),
        (F.col("doc_id") % n).alias("_item"),
    )
    return docs.join(refs, "_item").withColumnRenamed("_item", "item_id")


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items as test cases whose true value is their number, with outer blanks."""
    return table(spark, folder, "benchmark").select(
        F.col("item_id").cast("int").alias("test_no"), F.concat(F.lit(" "), "text", F.lit("\n")).alias("ground_truth"),
        F.concat(F.lit(" "), F.col("item_id").cast("string")).alias("extracted_true_value"),
    )


ANSWERS_SQL = """
answers AS (SELECT doc_id AS query_result_id, d.text AS response, item_id, b.text AS reference
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
keys AS (SELECT regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') AS k, CAST(arg_max(item_id, item_id) AS DOUBLE) AS true_value FROM benchmark GROUP BY 1)"""


def dialogue(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as agent logs: a user's turn opens a statement."""
    opening = F.concat(F.lit("INFO Running: "), "text")
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("line_no"),
        F.when(F.col("role") == "user", opening).otherwise(F.col("text")).alias("line"), "role",
    )


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Events as positions with speed and a fuel rate."""
    key = F.col("event_id")
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("vessel_id"), F.col("ts").alias("time"), key.alias("event_id"),
        (F.lit(59.0) + key % 997 / 1000.0).alias("lat"), (F.lit(18.0) + key % 991 / 1000.0).alias("lon"),
        F.col("value").alias("sog"), (F.col("value") * 2).alias("engine_1_fuelcons_lph"),
    )


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """The same as long telemetry, four readings per event."""
    names = {
        "positioningsystem_latitude_deg_1": "lat", "positioningsystem_longitude_deg_1": "lon",
        "positioningsystem_sog_kn_1": "sog", "engine_1_fuelcons_lph": "engine_1_fuelcons_lph",
    }
    parts = [F.struct(F.lit(p).alias("parameter_id"), F.col(c).cast("double").alias("value")) for p, c in names.items()]
    return points(spark, folder).select("vessel_id", "time", "event_id", F.inline(F.array(*parts)))


def event_telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """Events as long telemetry with the event type as the parameter."""
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("vessel_id"), F.col("ts").alias("time"),
        F.col("event_type").alias("parameter_id"), "value", "event_id",
    )


def departures(spark: SparkSession, folder: str) -> DataFrame:
    """One departure 37 minutes after each event, by ferry name."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("trip_id"), F.concat(F.lit("Vessel"), F.col("user_id").cast("string")).alias("ferry_name"),
        (F.col("ts") + F.make_dt_interval(mins=F.lit(37))).alias("time_departure"),
    )


def vessel_names(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("user_id").cast("string")
    return table(spark, folder, "events").select(
        F.concat(F.lit("VESSEL"), number).alias("name"), number.alias("vessel_id")
    ).distinct()


_H = """(pow(sin(radians({lat} - {plat}) / 2), 2)
      + cos(radians({plat})) * cos(radians({lat})) * pow(sin(radians({lon} - {plon}) / 2), 2))"""
HAVERSINE_SQL = f"(2 * 6371000 * atan2(sqrt({_H}), sqrt(1 - {_H})))"

_STEP = HAVERSINE_SQL.format(lat="lat", lon="lon", plat="lag(lat) OVER w", plon="lag(lon) OVER w")


def segments_sql(by: str, gap_seconds: float) -> str:
    """Points with trip numbers and steps, by the given partition columns."""
    return f"""
points AS (SELECT CAST(user_id AS VARCHAR) AS vessel_id, ts AS time, event_id, CAST(ts + INTERVAL 1 HOUR AS DATE) AS day,
    date_trunc('second', ts + INTERVAL 1 HOUR) AS local_time, 59 + event_id % 997 / 1000.0 AS lat,
    18 + event_id % 991 / 1000.0 AS lon, value AS sog, value * 2 AS fuel FROM events WHERE value >= 1.0),
steps AS (SELECT *, epoch_us(time) - epoch_us(lag(time) OVER w) AS gap_us, {_STEP} AS step
  FROM points WINDOW w AS (PARTITION BY {by} ORDER BY time)),
segments AS (SELECT *, sum(CASE WHEN gap_us > {int(gap_seconds * 1e6)} THEN 1 ELSE 0 END)
    OVER (PARTITION BY {by} ORDER BY time ROWS UNBOUNDED PRECEDING) AS trip_no,
    CASE WHEN gap_us IS NULL OR gap_us > {int(gap_seconds * 1e6)} THEN 0 ELSE step END AS step_m FROM steps),
trip_table AS (SELECT {by}, trip_no, min(local_time) AS start_time, max(local_time) AS end_time, count(*) AS n_points,
    sum(step_m) / 1852 AS distance_nm, sum(fuel * 5 / 3600) AS fuel_l FROM segments GROUP BY ALL HAVING count(*) > 1)"""
