"""Typed readers of trips, registries, timetables and test cases.

Every reader is a text or JSON scan followed by a parse step; the parse steps are
public, so the same rules apply to rows from any other source.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.functions.text import strip

# Columns of the trip table.
_COUNTS = ("cars", "trucks", "trucks_with_trailer", "motorcycles", "exemption_vehicles", "pedestrians", "buses",
           "vehicles_left_at_terminal")
_SIDES = ("outbound", "inbound")
TRIP_COLUMNS: dict[str, str] = {
    "route_id": "int", "route_name": "string", "ferry_name": "string", "ferry_id": "int",
    "terminal_departure": "string", "terminal_arrival": "string", "time_departure": "timestamp_ntz",
    **{f"{c}_{s}": "int" for c in _COUNTS for s in _SIDES},
    "trip_type": "string", "passenger_car_equivalent_outbound_and_inbound": "double", "tailored_trip": "int",
    "full_ferry_outbound": "int", "full_ferry_inbound": "int",
    **{f"passenger_car_equivalent_{s}": "double" for s in _SIDES},
    **{c.format(s): k for s in _SIDES for c, k in (
        ("fuelcons_{}_l", "double"), ("distance_{}_nm", "double"), ("start_time_{}", "timestamp_ntz"),
        ("end_time_{}", "timestamp_ntz"))},
}


def parse_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns to types: blanks trimmed, ``nan`` and what does not parse become null."""
    def typed(name: str, kind: str):
        text = strip(F.col(name).cast("string"))
        text = F.when(~F.lower(text).isin("nan", "nat", ""), text)
        if kind == "string":
            return text
        if kind == "int":
            # Counts may be written as 3.0.
            return text.try_cast("double").try_cast("int")
        return text.try_cast(kind)
    return df.withColumns({n: typed(n, k) for n, k in kinds.items() if n in df.columns})


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    """The trip CSV by header names; columns it lacks are absent from the result."""
    raw = spark.read.option("header", "true").csv(path)  # all text: one header line is read, no inference
    return parse_columns(raw, TRIP_COLUMNS)


def _machine(*extra: tuple[str, str]) -> str:
    return ", ".join(f"{n}: {k}" for n, k in (("type", "string"), ("location", "string"), *extra, ("year_manufactured", "int")))


FLEET_FIELDS = {
    "length_over_all_m": "double", "length_between_perpendiculars_m": "double", "breadth_m": "double", "draft_m": "double",
    "max_speed_kn": "double", "installed_power_kw": "double", "capacity_passenger_car_equivalent": "double",
    "gross_tonnage": "double", "net_tonnage": "double", "number_of_engines": "int",
}


def fleet_type(id_field: str) -> str:
    fields = ", ".join(f"{n}: {k}" for n, k in FLEET_FIELDS.items())
    engines = _machine(("power_kw", "double"), ("rpm", "double"))
    propulsion = _machine(("propeller_diameter_mm", "double"))
    return (f"struct<{id_field}: string, {fields}, machinery: struct<"
            f"engines: array<struct<{engines}>>, propulsion: array<struct<{propulsion}>>>>")


def parse_fleet(texts: DataFrame, id_field: str = "vessel_id", text: str = "value") -> DataFrame:
    """Keyed JSON objects to a row per ferry; absent fields are null."""
    keyed = F.from_json(F.col(text), f"map<string, {fleet_type(id_field)}>")
    rows = texts.select(F.explode(keyed).alias("name", "spec")).select("name", "spec.*")
    return rows if id_field == "vessel_id" else rows.withColumnRenamed(id_field, "vessel_id")


def read_fleet(spark: SparkSession, path: str, id_field: str = "vessel_id") -> DataFrame:
    return parse_fleet(spark.read.text(path, wholetext=True), id_field)


def fleet_engines(fleet: DataFrame) -> DataFrame:
    """A row per engine; ferries without one keep a row of nulls."""
    return fleet.select("name", F.explode_outer("machinery.engines").alias("engine")).select("name", "engine.*")


def fleet_propulsion(fleet: DataFrame) -> DataFrame:
    return fleet.select("name", F.explode_outer("machinery.propulsion").alias("unit")).select("name", "unit.*")


ROUTES_TYPE = (
    "routes array<struct<route_name: string, ferries: array<string>, location: string, ferry_line_length_m: int, "
    "crossing_time_in_minutes: int, schedule: string>>"
)


def parse_routes(df: DataFrame) -> DataFrame:
    return df.select(F.inline("routes"))


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    return parse_routes(spark.read.schema(ROUTES_TYPE).option("multiLine", "true").json(path))


CLOCK = r"^\s*([01]?\d|2[0-4])[:.]([0-5]\d)\s*$"


def parse_timetable(rows: DataFrame, time: str = "Timestamp", route: str = "Route") -> DataFrame:
    """Clock texts and routes to (route, slot in seconds); stray rows drop out."""
    hours, minutes = (F.regexp_extract(time, CLOCK, i).try_cast("int") for i in (1, 2))
    return rows.filter(F.col(time).rlike(CLOCK) & F.col(route).isNotNull()).select(
        strip(F.col(route)).alias("route"), (hours * 3600 + minutes * 60).cast("double").alias("slot"))


def timetable_rejects(rows: DataFrame, time: str = "Timestamp", route: str = "Route") -> DataFrame:
    return rows.filter(~F.coalesce(F.col(time).rlike(CLOCK) & F.col(route).isNotNull(), F.lit(False)))


def read_timetable(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    schema = "Timestamp string, Route string, _corrupt_record string"
    return parse_timetable(spark.read.schema(schema).option("header", "true").csv(paths))


def unpivot_timetable(wide: DataFrame, hour: str = "Hour", remarks: str = "Remarks") -> DataFrame:
    """One column per holiday to (hour, holiday, minutes text, remarks) rows; empty cells drop out."""
    days = [c for c in wide.columns if c not in (hour, remarks)]
    ids = [c for c in (hour, remarks) if c in wide.columns]
    return wide.unpivot(ids, days, "holiday", "departures").filter(
        F.col("departures").isNotNull() & (strip(F.col("departures")) != ""))


def read_holiday_timetable(spark: SparkSession, path: str) -> DataFrame:
    return unpivot_timetable(spark.read.option("header", "true").csv(path))


TEST_CASE_TYPE = (
    "test_no int, query string, reference_contexts array<string>, ground_truth string, extracted_true_value string, "
    "synthesizer_name string, query_complexity string, maritime_domain_category string, data_interaction_type string"
)


def read_test_cases(spark: SparkSession, path: str) -> DataFrame:
    return parse_test_cases(spark.read.schema(TEST_CASE_TYPE).option("multiLine", "true").json(path))


def parse_test_cases(df: DataFrame) -> DataFrame:
    """Trim the recorded value, which may start with a blank."""
    return df.withColumn("extracted_true_value", strip(F.col("extracted_true_value")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literal_list(text: pd.Series) -> pd.Series:
    def parse(value):
        try:
            found = ast.literal_eval(value)
        except (ValueError, SyntaxError):
            return [value]
        return [str(v) for v in found] if isinstance(found, (list, tuple)) else [str(found)]
    return text.map(parse, na_action="ignore")


def list_literal(name: str):
    """A list literal as an array. JSON parsing covers most; the rest go through Python."""
    text = F.col(name)
    parsed = F.from_json(text, "array<string>")
    return F.coalesce(parsed, _literal_list(F.when(parsed.isNull(), text)))


def convert_testset(df: DataFrame, start: int = 1) -> DataFrame:
    """Test-set rows as test cases numbered by their index."""
    return df.select(
        (F.col("_c0").cast("int") + start).alias("test_no"), F.col("user_input").alias("query"),
        list_literal("reference_contexts").alias("reference_contexts"), F.col("reference").alias("ground_truth"),
        "synthesizer_name",
    )


def read_testset(spark: SparkSession, path: str) -> DataFrame:
    schema = "_c0 int, user_input string, reference_contexts string, reference string, synthesizer_name string"
    return spark.read.schema(schema).option("header", "true").option("multiLine", "true").option(
        "escape", '"').csv(path)
