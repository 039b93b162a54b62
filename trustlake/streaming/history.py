"""Numbered events and bounded history as state of a stream.

Events (ts, kind, payload) go to lanes of their kind by a hash of the payload,
so that a kind that most events have is spread over ``LANES`` groups. Each lane
numbers its events from 0 without gaps, in the order of arrival, and keeps its
latest ``RECENT``. Numbers and history live in the state store: a restart goes
on from the checkpoint, and the history is read from the state itself, at most
``LANES`` times ``RECENT`` rows a kind, however long the log is.

Null kinds are a kind, null payloads go to the lane of empty ones, events without a time are
the oldest; of equal times the larger payload is the later one; repeated events
are events of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trustlake.functions.portable import hash32

LANES = 16
RECENT = 50
#: Microseconds of events without a time.
NEVER = -(1 << 62)


def _step(recent: int):
    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, at, payload = state.get if state.exists else (0, [], [])
        held = [(a, p or "", p) for a, p in zip(at, payload, strict=True)]
        for frame in frames:
            new = [(int(a), p or "", p) for a, p in zip(frame["at"], frame["payload"], strict=True)]
            held = heapq.nlargest(recent, held + new, key=lambda e: e[:2])
            yield pd.DataFrame({"kind": frame["kind"], "lane": frame["lane"], "number": range(number, number + len(frame)), "at": frame["at"], "payload": frame["payload"]})
            number += len(frame)
        state.update((number, [a for a, _, _ in held], [p for _, _, p in held]))

    return run


def numbered(events: DataFrame, *, lanes: int = LANES, recent: int = RECENT) -> DataFrame:
    """A stream of events (ts, kind, payload) as kind, lane, number, at (microseconds), payload."""
    payload = F.col("payload").cast("string")
    lane = (hash32(payload) % lanes).cast("int")
    rows = events.select(F.col("kind").cast("string").alias("kind"), lane.alias("lane"), F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(NEVER)).alias("at"), payload.alias("payload"))
    return rows.groupBy("kind", "lane").applyInPandasWithState(
        _step(recent), "kind string, lane int, number long, at long, payload string", "number long, at array<long>, payload array<string>", "append", GroupStateTimeout.NoTimeout
    )


def run_numbered(events: DataFrame, path: str, *, lanes: int = LANES, recent: int = RECENT) -> StreamingQuery:
    """Number what is there, into the table ``path``/log; state and progress are in ``path``/state."""
    out = numbered(events, lanes=lanes, recent=recent).writeStream.format("parquet").option("path", f"{path}/log").option("checkpointLocation", f"{path}/state")
    query = out.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _lanes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("statestore").load(f"{path}/state").select("key.kind", "key.lane", "value.groupState.*")


def history(spark: SparkSession, path: str, recent: int = RECENT) -> DataFrame:
    """The latest events of each kind, latest first: kind, rank, at, payload. Reads the state, not the log."""
    rows = _lanes(spark, path).select("kind", F.explode(F.arrays_zip("at", "payload")).alias("e")).select("kind", "e.at", "e.payload")
    latest = W.partitionBy("kind").orderBy(F.desc("at"), F.desc(F.coalesce("payload", F.lit(""))))
    return rows.withColumn("rank", F.row_number().over(latest)).filter(F.col("rank") <= recent)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Events so far by kind, from the lanes' numbers."""
    return _lanes(spark, path).groupBy("kind").agg(F.sum("number").alias("n"))


def replay(spark: SparkSession, path: str, since: DataFrame) -> DataFrame:
    """The log's events from each lane's number in ``since`` (kind, lane, number: the first one wanted); lanes that aren't in it from 0."""
    log = spark.read.parquet(f"{path}/log").alias("l")
    seen = since.select("kind", "lane", F.col("number").alias("first")).alias("s")
    return log.join(F.broadcast(seen), F.col("l.kind").eqNullSafe(F.col("s.kind")) & (F.col("l.lane") == F.col("s.lane")), "left").filter(F.col("number") >= F.coalesce("first", F.lit(0))).select("l.*")
