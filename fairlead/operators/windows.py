"""Ordered computations by key: neighbours, running sums, segments, positions, statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions.calendar import seconds_between
from fairlead.functions.text import strip
from fairlead.operators import scan


def with_previous(df: DataFrame, by: list[str], ts: str, cols: dict[str, str], tiebreak: list[str] = (),
                  bounded: bool = False) -> DataFrame:
    """Add the previous row's values: ``cols`` maps a source column to its new name."""
    order = [ts, *tiebreak]
    return scan.by_ranges(df, by, order, lambda rows, ranges: scan.neighbour(rows, ranges, by, order, cols), bounded)


def lag_seconds(df: DataFrame, by: list[str], ts: str, out: str = "dt", tiebreak: list[str] = ()) -> DataFrame:
    """Seconds since the previous row of the key; null on its first row."""
    df = with_previous(df, by, ts, {ts: "_previous_ts"}, tiebreak)
    return df.withColumn(out, seconds_between("_previous_ts", ts)).drop("_previous_ts")


def running_sum(df: DataFrame, by: list[str], order: list[str], value: Column, out: str, bounded: bool = False) -> DataFrame:
    """Inclusive running sum in ``order``, whose keys should be unique within ``by``."""
    return scan.by_ranges(df, by, order, lambda rows, ranges: scan.running(rows, ranges, by, order, value, out), bounded)


def segment(df: DataFrame, by: list[str], ts: str, gap: float, out: str = "trip_no", tiebreak: list[str] = ()) -> DataFrame:
    """Number runs of rows; a new run starts after a gap strictly above ``gap`` seconds."""
    order = [ts, *tiebreak]

    def step(rows: DataFrame, ranges: list[str]) -> DataFrame:
        rows = scan.neighbour(rows, ranges, by, order, {ts: "_previous_ts"}).withColumn("dt", seconds_between("_previous_ts", ts))
        breaks = (F.coalesce(F.col("dt"), F.lit(0.0)) > gap).cast("int")
        return scan.running(rows.drop("_previous_ts"), ranges, by, order, breaks, out)
    return scan.by_ranges(df, by, order, step)


def position(df: DataFrame, order: str, out: str = "position", by: list[str] = ()) -> DataFrame:
    """1-based position by a unique order column, in all rows or per key."""
    return running_sum(df, list(by), [order], F.lit(1), out)


def argmax(df: DataFrame, by: list[str], value: str, tiebreak: list[str], lowest: bool = False) -> DataFrame:
    """The row with the highest (or lowest) value per key; smallest tiebreak on ties."""
    scored = df.filter(F.col(value).isNotNull())
    row = F.struct(*[c for c in df.columns if c not in by])
    rank = F.struct(F.col(value) if lowest else -F.col(value), *tiebreak)
    best = scored.groupBy(*by).agg(F.min_by(row, rank).alias("_row"))
    return best.select(*by, "_row.*")


def distinct_ordered(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Distinct values per key with their first order key and 1-based position."""
    first = df.groupBy(*by, value).agg(F.min(order).alias("first_at"))
    return position(first, "first_at", by=by)


def latest_status(log: DataFrame, by: list[str], status: str, order: str) -> DataFrame:
    """The status of the last attempt per key."""
    return log.groupBy(*by).agg(F.max_by(status, order).alias(status), F.max(order).alias(order))


def extract_sql(log: DataFrame, session: str = "session_id", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Statements of an agent log: ``Running:`` opens one, plain lines continue it."""
    marker = "Running:"
    opens = F.col(line).contains(marker)
    after = F.col(line).substr(F.locate(marker, line) + len(marker), F.length(line))
    body = strip(F.when(opens, after).otherwise(F.col(line)))
    lines = log.withColumns({"_open": opens.cast("int"), "_text": body})
    return statements(lines, [session], line_no, "_open", "_text")


def statements(lines: DataFrame, by: list[str], order: str, opens: str, text: str) -> DataFrame:
    """Group ordered lines into blocks at each opening line and join their texts."""
    numbered = running_sum(lines, by, [order], F.col(opens), "statement_no")
    opening = F.col(opens) == 1
    kept = numbered.filter(
        (F.col("statement_no") > 0) & (opening | ((F.col(text) != "") & ~F.col(text).startswith("INFO")))
    )
    # An opening line without text leaves no statement to continue.
    blocks = kept.groupBy(*by, "statement_no").agg(
        F.min(order).alias("first_line"),
        F.max(F.when(opening, F.col(text))).alias("_head"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]), " ").alias("sql"),
    )
    return blocks.filter(F.col("_head") != "").drop("_head").withColumn("sql", F.trim("sql"))


def preferred_order(df: DataFrame, name: str, preferred: list[str], out: str = "rank") -> DataFrame:
    """Listed names first in list order, all others behind them by name."""
    place = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(name))
    return df.withColumn(out, F.when(place > 0, place).otherwise(len(preferred) + 1)).orderBy(out, name)
