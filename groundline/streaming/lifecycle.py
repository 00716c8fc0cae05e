"""The life of generations as a stream with state: every step is checked against the one before, and candidates that nobody finishes time out.

Per generation the state holds the last step and its time. Steps of one
micro-batch are taken in the order of time and number. A step that is not legal
is given out as such and changes nothing; a candidate that stays one for longer
than ``patience`` of event time is given out as abandoned by its timer, and
steps after that start from there. What the stream has given out it gives out
once, also when it starts again from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from groundline.sources.publish import STEPS

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "generation_id bigint, event_id bigint, before string, state string, outcome string"
#: The state of a generation: its last legal step, and its timer.
HELD = StructType([StructField("state", StringType()), StructField("timer", LongType())])
FIRST, ABANDONED = "DB_CANDIDATE", "ABANDONED"


class Lifecycle(StatefulProcessor):
    """Rows ``generation_id, ts, event_id, state`` to ``OUT``: outcome is legal, illegal or abandoned."""

    def __init__(self, patience_ms: int) -> None:
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.last.get() if self.last.exists() else (None, None)
        state, timer = held[0], held[1]
        for row in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
            legal = row["state"] == FIRST if state is None else (state, row["state"]) in STEPS
            yield Row(generation_id=key[0], event_id=row["event_id"], before=state, state=row["state"], outcome="legal" if legal else "illegal")
            if legal:
                state = row["state"]
                if timer is not None:
                    self.handle.deleteTimer(timer)
                    timer = None
                if state == FIRST and self.patience_ms:
                    timer = int(row["ts"].timestamp() * 1000) + self.patience_ms
                    self.handle.registerTimer(timer)
        if state is not None:
            self.last.update((state, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.last.get() if self.last.exists() else None
        if held is not None and held[0] == FIRST:
            self.last.update((ABANDONED, None))
            yield Row(generation_id=key[0], event_id=None, before=FIRST, state=ABANDONED, outcome="abandoned")

    def close(self) -> None:
        pass


def checked_steps(log: DataFrame, *, patience_ms: int = 0, delay: str = "1 hour") -> DataFrame:
    """The checked steps of a streamed log ``generation_id, ts, event_id, state``; without patience nothing is abandoned.

    Needs RocksDB as the session's state store (``STORE``).
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    marked = log.select("generation_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "state").withWatermark("ts", delay)
    return marked.groupBy("generation_id").transformWithState(statefulProcessor=Lifecycle(patience_ms), outputStructType=StructType.fromDDL(OUT), outputMode="Append", timeMode="EventTime" if patience_ms else "None")


def steps_in_batch(log: DataFrame) -> DataFrame:
    """``checked_steps`` of a whole log at once, without patience.

    A generation has three legal steps at most: the first candidate, the first
    step from there that is legal, and the first from that one. Each is one
    aggregation, so the log of a hot generation is combined before it meets.
    """
    rows = log.withColumn("at", F.struct("ts", "event_id"))
    one = rows.filter(F.col("state") == FIRST).groupBy("generation_id").agg(F.min("at").alias("one"))
    step = F.struct("at", "state")
    follows = lambda held: F.array_contains(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in STEPS)), F.struct(held.alias("a"), F.col("state").alias("b")))
    two = rows.join(one, "generation_id").filter((F.col("at") > F.col("one")) & follows(F.lit(FIRST))).groupBy("generation_id").agg(F.min(step).alias("two"))
    three = rows.join(two, "generation_id").filter((F.col("at") > F.col("two.at")) & follows(F.col("two.state"))).groupBy("generation_id").agg(F.min(step).alias("three"))
    every = rows.join(one, "generation_id", "left").join(two, "generation_id", "left").join(three, "generation_id", "left")
    upto = lambda place: place.isNull() | (F.col("at") <= place)
    before = F.when(upto(F.col("one")), F.lit(None).cast("string")).when(upto(F.col("two.at")), F.lit(FIRST)).when(upto(F.col("three.at")), F.col("two.state")).otherwise(F.col("three.state"))
    legal = F.coalesce(F.col("at") == F.col("one"), F.lit(False)) | F.coalesce(F.col("at") == F.col("two.at"), F.lit(False)) | F.coalesce(F.col("at") == F.col("three.at"), F.lit(False))
    return every.select("generation_id", "event_id", before.alias("before"), "state", F.when(legal, "legal").otherwise("illegal").alias("outcome"))
