"""The gate as a stream: decisions, published summaries, new incidents, an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trustlake.operators.gate import decide, fuse, gate_batch_report, z_signal_literal


def stream_gate(sdf: DataFrame, flags: dict[str, float], allow: float = 0.4, sanitize: float = 0.7, *, text_col: str = "text") -> DataFrame:
    """Decisions for texts as they arrive; stateless projections, so batch and stream give the same."""
    return decide(fuse(z_signal_literal(sdf, flags, text_col=text_col), z_only=True), list(flags), allow, sanitize, text_col=text_col)


def publish_summary(path: str):
    """For ``foreachBatch``: one report per batch in a folder of its own, so that a repeated batch replaces its report."""

    def run(batch: DataFrame, batch_id: int) -> None:
        gate_batch_report(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return run


def stream_new(sdf: DataFrame, watermark: str = "1 hour", *, ts: str = "ts", key: str = "id") -> DataFrame:
    """The first event of each id; the watermark bounds how long ids are remembered."""
    return sdf.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


#: Rows that one batch can have before its sequence numbers reach those of the next.
BATCH = 1 << 40


def event_log(path: str):
    """For ``foreachBatch``: events (ts, kind, payload) with a sequence number that grows from batch to batch, and by time inside a batch, in folders by kind."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.repartitionByRange("ts", "kind", "payload").sortWithinPartitions("ts", "kind", "payload").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()).persist()
        # One row for each partition is ordered here.
        starts = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
        starts = starts.withColumn("start", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
        seq = F.lit(batch_id).cast("long") * F.lit(BATCH) + F.col("start") + F.col("row") - F.col("first")
        out = rows.join(F.broadcast(starts), "part").withColumn("seq", seq).drop("part", "row", "first", "start").withColumn("batch_id", F.lit(batch_id))
        out.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={batch_id}")
        rows.unpersist()

    return run


def replay(events: DataFrame, since: int) -> DataFrame:
    """Events after a sequence number, in order."""
    return events.filter(F.col("seq") > since).orderBy("seq")


def recent(events: DataFrame, n: int = 50) -> DataFrame:
    return events.orderBy(F.desc("seq")).limit(n)


def run_available(sdf: DataFrame, sink, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; a restart goes on from the checkpoint."""
    query = sdf.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
