"""Continuous jobs with states and timers of their own: trips of moving vessels, statements of agent logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import DoubleType, LongType, StructField, StructType, TimestampType

from fairlead.functions.text import strip
from fairlead.streaming.stream import _seconds

MICROS = 1_000_000


def _columns(rates) -> list[str]:
    """A piece: its first and last time, points, and per rate the first and last value and the sum over time."""
    return ["first_us", "last_us", "n_points", *[f"{k}_{r}" for r in rates for k in ("first", "last", "total")]]


def pieces(samples: pd.DataFrame, gap_us: int, rates) -> pd.DataFrame:
    """Runs of samples without a pause longer than the gap; totals are rate times hours, by trapezoids."""
    samples = samples.sort_values("us", kind="stable")
    us = samples["us"].to_numpy()
    step = np.diff(us)
    starts = np.concatenate([[0], np.flatnonzero(step > gap_us) + 1]).astype(int)
    ends = np.append(starts[1:], len(us)) - 1
    out = {"first_us": us[starts], "last_us": us[ends], "n_points": ends - starts + 1}
    for rate in rates:
        values = samples[rate].to_numpy(float)
        areas = np.append(np.where(step > gap_us, 0.0, (values[:-1] + values[1:]) / 2 * step / (3600 * MICROS)), 0.0)
        out |= {f"first_{rate}": values[starts], f"last_{rate}": values[ends], f"total_{rate}": np.add.reduceat(areas, starts)}
    return pd.DataFrame(out)


def joined(parts: list[dict], gap_us: int, rates) -> list[dict]:
    """Pieces in time order, those that the gap does not part made one."""
    out: list[dict] = []
    for part in parts:
        if not out or part["first_us"] - out[-1]["last_us"] > gap_us:
            out.append(dict(part))
            continue
        last = out[-1]
        hours = (part["first_us"] - last["last_us"]) / (3600 * MICROS)
        for r in rates:
            last[f"total_{r}"] += part[f"total_{r}"] + (last[f"last_{r}"] + part[f"first_{r}"]) / 2 * hours
            last[f"last_{r}"] = part[f"last_{r}"]
        last["last_us"], last["n_points"] = part["last_us"], last["n_points"] + part["n_points"]
    return out


def _fields(names) -> list[StructField]:
    return [StructField(c, LongType() if c.endswith("_us") or c == "n_points" else DoubleType()) for c in names]


class RangeSamples(StatefulProcessor):
    """Holds one vessel's samples of one time range until the range is over, then gives its pieces.

    With ``early`` the range's pieces so far come with every batch.
    """

    def __init__(self, gap_us: int, range_us: int, rates, early: bool):
        self.gap_us, self.range_us, self.rates, self.early = gap_us, range_us, tuple(rates), early

    def init(self, handle) -> None:
        self.handle = handle
        fields = [StructField("us", LongType()), *[StructField(r, DoubleType()) for r in self.rates]]
        self.samples = handle.getListState("samples", StructType(fields))
        self.names = [f.name for f in fields]

    def _given(self, key) -> pd.DataFrame:
        found = pieces(pd.DataFrame(list(self.samples.get()), columns=self.names), self.gap_us, self.rates)
        found.insert(0, "range_end", pd.Timestamp((key[1] + 1) * self.range_us, unit="us"))
        found.insert(0, "vessel_id", key[0])
        return found

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = not self.samples.exists()
        for frame in rows:
            self.samples.appendList(list(frame[self.names].itertuples(index=False, name=None)))
        if fresh:
            self.handle.registerTimer((key[1] + 1) * self.range_us // 1000)
        if self.early:
            yield self._given(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.early:
            yield self._given(key)
        self.samples.clear()

    def close(self) -> None:
        pass


class JoinRanges(StatefulProcessor):
    """Joins a vessel's pieces over the edges of ranges; a trip is out once no range that could continue it is open."""

    def __init__(self, gap_us: int, range_us: int, rates):
        self.gap_us, self.range_us, self.rates = gap_us, range_us, tuple(rates)
        self.names = _columns(self.rates)

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", StructType(_fields(self.names)))

    def _trips(self, key, trips: list[dict]) -> pd.DataFrame:
        made = pd.DataFrame(trips, columns=self.names)
        made.insert(0, "vessel_id", [key[0]] * len(trips))
        return made

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = pd.concat(list(rows)).sort_values("first_us")[self.names].to_dict("records")
        if self.open.exists():
            parts.insert(0, dict(zip(self.names, self.open.get())))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        *trips, last = joined(parts, self.gap_us, self.rates)
        self.open.update(tuple(int(last[c]) if f.dataType == LongType() else float(last[c])
                               for c, f in zip(self.names, _fields(self.names))))
        self.handle.registerTimer(((last["last_us"] + self.gap_us) // self.range_us + 1) * self.range_us // 1000)
        yield self._trips(key, trips)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._trips(key, [dict(zip(self.names, self.open.get()))])
        self.open.clear()

    def close(self) -> None:
        pass


def _by_range(df: DataFrame, watermark: str, range_us: int, rates, by: str, time: str) -> DataFrame:
    us = F.unix_micros(F.col(time).cast("timestamp"))
    return df.withWatermark(time, watermark).select(
        F.col(by).alias("vessel_id"), F.floor(us / range_us).cast("long").alias("range_no"), F.col(time), us.alias("us"),
        *[F.col(r).cast("double").alias(r) for r in rates]).groupBy("vessel_id", "range_no")


def _range_schema(df: DataFrame, by: str, rates) -> StructType:
    return StructType([StructField("vessel_id", df.schema[by].dataType), StructField("range_end", TimestampType()),
                       *_fields(_columns(rates))])


def _named(df: DataFrame, rates) -> DataFrame:
    return df.select("vessel_id", F.timestamp_micros("first_us").alias("start_time"), F.timestamp_micros("last_us").alias("end_time"),
                     "n_points", *[F.col(f"total_{r}") for r in rates])


def live_trips(df: DataFrame, gap: str, watermark: str, range: str = "1 hour", rates: tuple[str, ...] = ("sog",),
               by: str = "vessel_id", time: str = "time") -> DataFrame:
    """Trips of a stream of samples as they end: start, end, points and per rate its total over the hours of the trip.

    A pause strictly longer than the gap ends a trip; trips of one point drop out. Samples are kept by vessel and time
    range, so a vessel's stream spreads over as many tasks as ranges are open, and a state holds one range at most.
    Ranges are joined by vessel from a few rows each. Samples may come in any order up to the batch in which the watermark
    passes the end of their range; later ones are dropped. Filters on speed belong before the call.
    Samples without a time are dropped; a null rate makes the totals of its trip null.
    """
    gap_us, range_us = int(_seconds(gap) * MICROS), int(_seconds(range) * MICROS)
    found = _by_range(df.filter(F.col(time).isNotNull()), watermark, range_us, rates, by, time).transformWithStateInPandas(
        RangeSamples(gap_us, range_us, rates, False), _range_schema(df, by, rates), "append", "eventTime",
        eventTimeColumnName="range_end")
    schema = StructType([StructField("vessel_id", df.schema[by].dataType), *_fields(_columns(rates))])
    trips = found.groupBy("vessel_id").transformWithStateInPandas(
        JoinRanges(gap_us, range_us, rates), schema, "append", "eventTime")
    return _named(trips, rates).filter("n_points > 1").select(
        "vessel_id", "start_time", "end_time", "n_points",
        *[F.when(~F.isnan(f"total_{r}"), F.col(f"total_{r}")).alias(f"total_{r}") for r in rates])


def running_trips(df: DataFrame, gap: str, watermark: str, range: str = "1 hour", rates: tuple[str, ...] = ("sog",),
                  by: str = "vessel_id", time: str = "time") -> DataFrame:
    """The pieces of the ranges that a batch touched, with their totals so far (update mode): a view before trips end."""
    gap_us, range_us = int(_seconds(gap) * MICROS), int(_seconds(range) * MICROS)
    return _named(_by_range(df.filter(F.col(time).isNotNull()), watermark, range_us, rates, by, time).transformWithStateInPandas(
        RangeSamples(gap_us, range_us, rates, True), _range_schema(df, by, rates), "update", "eventTime"), rates)


class OpenStatement(StatefulProcessor):
    """Collects the lines of a session's open statement; the next opening or a quiet time closes it."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.number = handle.getValueState("number", "n long")
        self.lines = handle.getListState("lines", "text string")

    def _close(self) -> str | None:
        text = " ".join(r[0] for r in self.lines.get()).strip() if self.lines.exists() else ""
        self.lines.clear()
        return text or None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("line_no", kind="stable")
        number, closed = (self.number.get()[0] if self.number.exists() else 0), []
        for _, block in frame.groupby(frame["opens"].cumsum()):
            if block["opens"].iloc[0]:
                closed.append((key[0], number, self._close()))
                number += 1
                if block["text"].iloc[0]:
                    self.lines.put([(t,) for t in block["text"]])
            elif self.lines.exists():
                self.lines.appendList([(t,) for t in block["text"]])
        self.number.update((number,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(frame["ms"].max()) + self.idle_ms)
        yield pd.DataFrame([c for c in closed if c[2]], columns=["session_id", "statement_no", "sql"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        text = self._close()
        yield pd.DataFrame([(key[0], self.number.get()[0], text)] if text else [], columns=["session_id", "statement_no", "sql"])

    def close(self) -> None:
        pass


def live_statements(lines: DataFrame, idle: str, watermark: str = "0 seconds") -> DataFrame:
    """Statements of agent logs (session_id, line_no, time, line), each as it closes; the stream itself gives the last one.

    ``Running:`` opens a statement, plain lines continue it, lines that begin with INFO do not. A session's open
    statement closes once the event time has moved on by ``idle`` since the session's last line of a statement; lines
    of any session or a heartbeat (a line of a session without an id) move it. Only lines that matter reach the state. Rows of a session
    come in order between batches. Lines without a time or a session close nothing and give nothing.
    """
    marker = "Running:"
    opens = F.col("line").contains(marker)
    after = F.col("line").substr(F.locate(marker, "line") + len(marker), F.length("line"))
    parsed = lines.withWatermark("time", watermark).select(
        "session_id", "line_no", "time", F.unix_millis(F.col("time").cast("timestamp")).alias("ms"),
        opens.alias("opens"), strip(F.when(opens, after).otherwise(F.col("line"))).alias("text"))
    matters = F.col("session_id").isNotNull() & (F.col("opens") | ((F.col("text") != "") & ~F.col("text").startswith("INFO")))
    # A condition on the event time stays above the watermark, which all lines move.
    kept = parsed.filter(F.when(matters, F.col("ms")).isNotNull())
    return kept.groupBy("session_id").transformWithStateInPandas(
        OpenStatement(int(_seconds(idle) * 1000)), StructType([lines.schema["session_id"], StructField("statement_no", LongType())]).add("sql", "string"),
        "append", "eventTime")
