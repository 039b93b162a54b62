"""Numbers and history in a stream's state, over restarts."""

from __future__ import annotations

import collections

from pyspark.sql import functions as F

from trustlake.sources.shared import folder
from trustlake.streaming import history

SCHEMA = "ts timestamp, kind string, payload string"


def test_restarts_lose_and_double_nothing(spark):
    source, path = folder(spark), folder(spark)
    made = []
    for k in range(3):
        # One kind has most events; times go up and down between the runs.
        rows = spark.range(k * 400, (k + 1) * 400).select(F.timestamp_seconds((F.col("id") * 7919) % 1009).alias("ts"), F.when(F.col("id") % 5 == 0, "rare").otherwise("hot").alias("kind"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("payload"))
        rows.write.mode("append").parquet(source)
        made += [(r.ts, r.kind, r.payload) for r in rows.collect()]
        history.run_numbered(spark.readStream.schema(SCHEMA).parquet(source), path, lanes=4)
        # A run without anything new changes nothing.
        history.run_numbered(spark.readStream.schema(SCHEMA).parquet(source), path, lanes=4)
        log = spark.read.parquet(f"{path}/log").collect()
        assert collections.Counter(r.payload for r in log) == collections.Counter(p for _, _, p in made)
        by_lane = collections.defaultdict(list)
        for r in log:
            by_lane[r.kind, r.lane].append(r.number)
        assert all(sorted(v) == list(range(len(v))) for v in by_lane.values()) and len(by_lane) == 8
        got = collections.defaultdict(list)
        for r in history.history(spark, path).orderBy("kind", "rank").collect():
            got[r.kind].append(r.payload)
        for kind in ("hot", "rare"):
            want = sorted(((t, p) for t, x, p in made if x == kind), reverse=True)[:50]
            assert got[kind] == [p for _, p in want]
        assert {r.kind: r.n for r in history.totals(spark, path).collect()} == collections.Counter(x for _, x, _ in made)
    since = spark.createDataFrame([("hot", 0, 5), ("hot", 1, 1 << 40)], "kind string, lane int, number long")
    want = {(r.kind, r.lane, r.number) for r in log if not (r.kind == "hot" and r.lane == 0 and r.number < 5) and not (r.kind == "hot" and r.lane == 1)}
    assert {(r.kind, r.lane, r.number) for r in history.replay(spark, path, since).collect()} == want


def test_odd_events(spark):
    source, path = folder(spark), folder(spark)
    rows = spark.createDataFrame([(None, "a", "x"), (None, None, None), (None, "a", "x"), (None, "a", None)], SCHEMA)
    rows.withColumn("at", F.lit(1)).write.parquet(source)
    history.run_numbered(spark.readStream.schema(SCHEMA).parquet(source), path)
    got = sorted((r.kind or "", r.rank, r.payload or "") for r in history.history(spark, path).collect())
    assert got == [("", 1, ""), ("a", 1, "x"), ("a", 2, "x"), ("a", 3, "")]
