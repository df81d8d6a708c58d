"""Streaming twins of the keyed operators: watermark dedup, and stateful processors where analytic windows are not allowed.

State expires by event time: a watermark bounds it, or a time-to-live on the state handle. The processors take any rows, by
any key: a row travels through them as its JSON text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewater.functions import EXACT
from tidewater.sinks import stream_batches, upsert

DAY_MS = 86_400_000


def first_of_day(rows: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """First arrival of each key and day of ``ts``."""
    dated = rows.withWatermark(ts, delay).withColumn("day_", F.to_date(ts))
    return dated.dropDuplicatesWithinWatermark([*keys, "day_"]).drop("day_")


def join_within(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, how: str = "inner", bound: str = "3 days") -> DataFrame:
    """Stream-stream join whose state lives for ``bound``: rows meet if their times are that close; left rows without a match come out after it."""
    a = left.withWatermark(left_ts, "2 seconds")
    b = right.withColumnRenamed(key, "_k").withWatermark(right_ts, "2 seconds")
    near = F.expr(f"{key} = _k AND {right_ts} BETWEEN {left_ts} - INTERVAL {bound} AND {left_ts} + INTERVAL {bound}")
    return a.join(b, near, "left_outer" if how == "left" else how).drop("_k")


def in_order(rows: DataFrame, ts: str) -> DataFrame:
    """Watermark of a source whose times only grow: nothing is waited for."""
    return rows.withWatermark(ts, "0 seconds")


def keep_latest(rows: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str):
    """Stream into a table with the latest row of each key."""
    return stream_batches(rows, lambda batch, _: upsert(batch, path, keys, order), checkpoint)


def _packed(rows: DataFrame, key: str, ts: str, tie: str | None, **more: Column) -> DataFrame:
    """Rows as a processor takes them: key_ (text), at_ (ms), tie_, row_ (JSON), further columns."""
    order = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
    return rows.select(F.col(key).cast("string").alias("key_"), F.unix_millis(ts).alias("at_"), order.alias("tie_"), F.to_json(F.struct(*rows.columns), EXACT).alias("row_"), *[c.alias(n) for n, c in more.items()])


def _unpacked(out: DataFrame, rows: DataFrame, *more: Column, keep: str | None = None) -> DataFrame:
    """The columns of ``rows`` from their text, and further ones. ``keep`` is taken from ``out`` as it is, with its watermark."""
    parsed = out.withColumn("_r", F.from_json("row_", rows.schema, EXACT))
    return parsed.select(*[F.col(c) if c == keep else F.col("_r")[c].alias(c) for c in rows.columns], *more)


class _Bounces(StatefulProcessor):
    """Rows of a key wait, sorted, until the watermark has passed them; an entry then shows as a bounce or not.

    The entry stays as pending until its next row or until its bound has passed; a timer at that time ends the wait.
    """

    def __init__(self, bound_ms: int):
        self.bound = bound_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long, tie long, row string", "entry boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for ts, tie, row, entry in zip(part["at_"], part["tie_"], part["row_"], part["entry_"], strict=True):
                self.waiting.updateValue((int(ts), int(tie), row), (bool(entry),))
                self.handle.registerTimer(int(ts) + 1)
                if entry:
                    self.handle.registerTimer(int(ts) + self.bound)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted((k[0], k[1], k[2], v[0]) for k, v in self.waiting.iterator())
        out = []
        for k, (ts, tie, row, entry) in enumerate(held):
            after = held[k + 1] if k + 1 < len(held) else None
            if ts > passed:
                break
            if after is not None and after[0] > passed and ts + self.bound > passed:
                break
            if after is None and ts + self.bound > passed and entry:
                break
            if entry and (after is None or after[3] or after[0] >= ts + self.bound):
                out.append((row,))
            if after is None or after[0] <= passed or ts + self.bound <= passed:
                self.waiting.removeKey((ts, tie, row))
        if out:
            yield pd.DataFrame(out, columns=["row_"])

    def close(self) -> None:
        pass


def bounces(rows: DataFrame, ts: str, bound_ms: int, delay: str = "2 seconds", key: str = "user_id", entry: str = "entry", tie: str | None = None) -> DataFrame:
    """Rows that are session entries (the boolean column ``entry``) and stay alone: those whose bound passed and those followed by another entry.

    Rows of one time go by ``tie`` (a whole number), then by their text. Rows without a key or a time are left out. A row
    comes out when the watermark has passed what decides on it, so it is late for a watermark of its own stream: windows over
    bounces read them from where they were written.
    """
    timed = rows.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
    packed = _packed(timed, key, ts, tie, entry_=F.coalesce(F.col(entry), F.lit(False)), time_=F.col(ts))
    return _unpacked(packed.groupBy("key_").transformWithStateInPandas(_Bounces(bound_ms), "row_ string", "Append", "EventTime"), rows)


#: Days before a key's newest one that its state remembers; rows of older days count as days seen.
KEPT_DAYS = 35


class _Days(StatefulProcessor):
    """Per key the first day and the recent days seen; ``judge`` turns a row and those into output columns and the new first day."""

    def __init__(self, judge, ttl_ms: int | None = None, forget_days: int | None = None):
        self.judge, self.ttl, self.forget = judge, ttl_ms, forget_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("days", "first long, days array<long>", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, days = self.state.get() if self.state.exists() else (None, [])
        days = {int(d) for d in days}
        table = pd.concat(list(rows)).sort_values(["at_", "tie_", "row_"])
        out = []
        for day, flag, row, time in zip(table["day_"], table["flag_"], table["row_"], table["time_"], strict=True):
            day = int(day)
            known = day in days or bool(days) and day < max(days) - KEPT_DAYS
            made, first = self.judge(day, int(flag), first, days, known)
            days.add(day)
            if made is not None:
                out.append((row, time, *made))
        newest = max(days)
        self.state.update((first, sorted(d for d in days if d >= newest - KEPT_DAYS)))
        if self.forget:
            self.handle.registerTimer((newest + self.forget) * DAY_MS)
        if out:
            yield pd.DataFrame(out, columns=["row_", "time_", "a_", "b_"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.forget and self.state.exists() and (max(self.state.get()[1]) + self.forget) * DAY_MS <= timerValues.getCurrentWatermarkInMs():
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _repair(day, flag, first, days, known):
    first = (day if flag else day - 1) if first is None else first
    return (0 if flag and day != first else flag, 0), first


def _returning(gap):
    def judge(day, flag, first, days, known):
        before = max((d for d in days if d < day), default=None)
        return None if known else (1, int(before is not None and day - before >= gap)), day if first is None else first

    return judge


def _debut(day, flag, first, days, known):
    return None if known else (1, int(first is None)), day if first is None else first


def _debut_marked(day, flag, first, days, known):
    return (int(not known), int(first is None)), day if first is None else first


def _days(rows: DataFrame, ts: str, judge, ttl_ms: int | None, key: str, tie: str | None, flag: str | None, delay: str | None, forget_days: int | None, a: str, b: str | None = None) -> DataFrame:
    if ttl_ms and delay:
        raise ValueError("a time-to-live needs processing time, a watermark event time: state has one or the other")
    if forget_days and not delay:
        raise ValueError("state that is forgotten by event time needs a watermark: give its delay")
    if tie is None and "event_id" in rows.columns and dict(rows.dtypes)["event_id"] in ("bigint", "int"):
        tie = "event_id"
    timed = rows.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    timed = timed.withWatermark(ts, delay) if delay else timed
    packed = _packed(timed, key, ts, tie, flag_=F.col(flag).cast("int") if flag else F.lit(0), day_=F.unix_date(F.to_date(ts)), time_=F.col(ts))
    # A time-to-live needs processing time, in which Spark never runs out of batches without data, so that "availableNow" does not
    # end unless spark.sql.streaming.noDataMicroBatches.enabled is off.
    mode = "EventTime" if delay else "ProcessingTime" if ttl_ms else "None"
    kind = "row_ string, time_ timestamp, a_ int, b_ int"
    carried = {"eventTimeColumnName": "time_"} if delay else {}
    out = packed.groupBy("key_").transformWithStateInPandas(_Days(judge, ttl_ms, forget_days), kind, "Append" if delay else "Update", mode, **carried)
    made = [F.col("a_").alias(a), *([F.col("b_").alias(b)] if b else [])]
    return _unpacked(out.withColumnRenamed("time_", ts), rows.drop(a, *([b] if b else [])), *made, keep=ts)


def repair_is_new(rows: DataFrame, ts: str, ttl_ms: int | None = None, key: str = "user_id", flag: str = "flag", tie: str | None = None, delay: str | None = None, forget_days: int | None = None) -> DataFrame:
    """``rows`` with is_new: the flag repaired by the key's first visit; rows of a key in time order across batches. Rows without a key or a time are left out.

    ``ttl_ms``: forget keys unseen for so long, by the clock. ``delay``: set and carry on a watermark of that delay, for windows
    behind it; then ``forget_days``: forget keys whose newest day is so many days before the watermark.
    """
    return _days(rows, ts, _repair, ttl_ms, key, tie, flag, delay, forget_days, "is_new")


def returning_users(rows: DataFrame, ts: str, gap: int = 8, ttl_ms: int | None = None, key: str = "user_id", tie: str | None = None, delay: str | None = None, forget_days: int | None = None) -> DataFrame:
    """The first arrival of each user and day, late days included, with uu (1) and back: each user and day comes out once. ``delay``, ``forget_days``: as above."""
    return _days(rows, ts, _returning(gap), ttl_ms, key, tie, None, delay, forget_days, "uu", "back")


def order_users(rows: DataFrame, ts: str, ttl_ms: int | None = None, key: str = "user_id", tie: str | None = None, delay: str | None = None, forget_days: int | None = None, every: bool = False) -> DataFrame:
    """The first order of each user and day with uu (1) and first_ever; with ``every`` all orders, uu and first_ever 0 for the others. ``delay``, ``forget_days``: as above."""
    return _days(rows, ts, _debut_marked if every else _debut, ttl_ms, key, tie, None, delay, forget_days, "uu", "first_ever")


class _Latest(StatefulProcessor):
    """Per key the latest row so far; it comes out once, when a timer of processing time set by the first row goes off."""

    def __init__(self, wait_ms: int, ttl_ms: int | None):
        self.wait, self.ttl = wait_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", "at long, row string", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, row = self.state.get() if self.state.exists() else (None, None)
        if at is not None and row is None:  # it has come out
            return iter(())
        if at is None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        for part in rows:
            for new, text in zip(part["order_"], part["row_"], strict=True):
                if at is None or int(new) >= at:
                    at, row = int(new), text
        self.state.update((at, row))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, row = self.state.get()
        self.state.update((at, None))
        yield pd.DataFrame([(row,)], columns=["row_"])

    def close(self) -> None:
        pass


def latest_after(rows: DataFrame, key: str, ts: str, wait_ms: int = 2000, ttl_ms: int | None = None) -> DataFrame:
    """One row of each key: the latest by ``ts`` (a timestamp; null: the oldest) that came within ``wait_ms`` of the key's first, of equal ones that which came later.

    Later rows of a key change nothing. ``ttl_ms``: forget keys unseen for so long. The wait is of processing time, so such a
    stream runs on a clock; "availableNow" would not end. Rows without a key are left out.
    """
    packed = _packed(rows.filter(F.col(key).isNotNull()), key, ts, None, order_=F.coalesce(F.unix_micros(ts), F.lit(-(1 << 62))))
    return _unpacked(packed.groupBy("key_").transformWithStateInPandas(_Latest(wait_ms, ttl_ms), "row_ string", "Append", "ProcessingTime"), rows)
