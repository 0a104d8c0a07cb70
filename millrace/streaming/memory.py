"""What is remembered of each person: the last notes, for some time. On streams as state that ends, on tables as of a moment."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: The state store that lists and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Memories(StatefulProcessor):
    """A person's notes in the order of time, as a list state; a timer at the moment when the oldest is forgotten."""

    def __init__(self, person: str, keep: int, forget_ms: int) -> None:
        self.person, self.keep, self.forget_ms = person, keep, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.notes = handle.getListState("notes", T.StructType([T.StructField("at", T.LongType()), T.StructField("note", T.StringType())]))

    def _settle(self, key: tuple, held: list[tuple[int, str]], now: int) -> Row:
        """Keeps what isn't forgotten, and only the last of it; a person without notes has no state."""
        held = sorted((x for x in held if x[0] > now - self.forget_ms), key=lambda x: (x[0], x[1] or ""))[-self.keep :]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.notes.put(held)
            self.handle.registerTimer(held[0][0] + self.forget_ms)
        else:
            self.notes.clear()
        return Row(**{self.person: key[0], "memories": [note for _, note in held]})

    def _held(self) -> list[tuple[int, str]]:
        return [(at, note) for at, note in self.notes.get()] if self.notes.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        yield self._settle(key, self._held() + [(r["_at"], r["note"]) for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield self._settle(key, self._held(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def memory_stream(notes: DataFrame, person: str = "user_id", keep: int = 20, forget: str = "7 days", late: str = "1 minute") -> DataFrame:
    """A stream of (person, memories) whenever a person's memories change: of the stream notes (person, ts, note) the last keep
    by time that aren't older than forget at the watermark. A late note takes its place among those kept; one that is
    forgotten leaves by a timer, and with the last the person's state ends. Rows without a time are never remembered; a null person is one
    person. Sets the session's state store to one that has lists and timers."""
    spark = notes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    forget_ms = spark.sql(f"select unix_millis(timestamp_seconds(0) + interval {forget}) as ms").first()["ms"]
    kind = notes.schema[person].dataType.simpleString()
    given = notes.filter("ts is not null").withWatermark("ts", late).select(person, "ts", F.unix_millis("ts").alias("_at"), F.col("note").cast("string").alias("note"))
    return given.groupBy(person).transformWithState(_Memories(person, keep, forget_ms), f"`{person}` {kind}, memories array<string>", "update", "eventTime")


def memories(notes: DataFrame, as_of: Column, person: str = "user_id", keep: int = 20, forget: str = "7 days") -> DataFrame:
    """(person, memories) of a table of notes as a stream would hold them at the moment as_of. Notes of a time, if equal, go by their
    text. Each task drops all but a person's last keep notes before anything is shuffled, so a person with very many
    notes is no large group."""
    moment = F.col("ts")
    known = notes.filter((moment <= as_of) & (moment > as_of - F.expr(f"interval {forget}")))
    place = F.row_number().over(Window.partitionBy(person).orderBy(F.desc("ts"), F.desc_nulls_last("note")))
    last = known.select(person, "ts", F.col("note").cast("string").alias("note")).withColumn("_place", place).filter(F.col("_place") <= keep)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("_place")).alias("k"), "note")))
    return last.groupBy(person).agg(F.transform(ordered, lambda x: x["note"]).alias("memories"))
