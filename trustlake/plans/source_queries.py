"""Registered queries: sources, sinks and streams, by round trips through the shared folder."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.operators import evaluate
from trustlake.plans import sql as S
from trustlake.plans.model_queries import FLAGS
from trustlake.plans.model_queries import O as MODEL_SQL
from trustlake.plans.text_queries import LABELLED, SCORER, docs, labelled, table
from trustlake.sources import readers, sinks
from trustlake.sources.shared import folder
from trustlake.streaming import gate_stream, history

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            O[name] = sql
        return f

    return keep


def digest(c: str) -> F.Column:
    return F.md5(F.col(c).cast("binary")).alias(f"{c}_md5")


@query("labelled_csv", f"SELECT md5(text) AS text_md5, label FROM {LABELLED} WHERE text <> ''")
def labelled_csv(spark, sf):
    """Labelled texts written as CSV and read back, quotes and line ends included."""
    path = folder(spark)
    sinks.write_csv(labelled(spark, sf).filter("text <> ''").select(F.col("text").alias("sentence"), "label"), path)
    return readers.read_labelled_csv(spark, path).select(digest("text"), "label")


@query("labelled_table", f"SELECT doc_id AS id, md5(text) AS text_md5, label FROM {LABELLED}")
def labelled_table(spark, sf):
    path = folder(spark)
    labelled(spark, sf).write.parquet(path)
    return readers.read_labelled(spark, path, id_col="doc_id").select("id", digest("text"), "label")


@query("records_json", "SELECT doc_id, md5(text) AS sentence_md5 FROM documents WHERE text IS NOT NULL")
def records_json(spark, sf):
    path = folder(spark)
    sinks.write_records(docs(spark, sf).select("doc_id", F.col("text").alias("sentence")), path)
    return readers.read_records(spark, path).select("doc_id", digest("sentence"))


@query("first_source", "SELECT 'text' AS text_column, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents")
def first_source(spark, sf):
    """The first source that exists, and its text column."""
    df = readers.first_existing(spark, [f"{sf}/no-such-table.parquet", f"{sf}/documents.parquet"])
    name = readers.resolve_text_col(df)
    return df.agg(F.count("*").alias("n"), F.sum(F.length(name)).alias("characters")).withColumn("text_column", F.lit(name))


@query("swap_vocabulary", "SELECT lower(n_name) AS word, reverse(lower(n_name)) AS repl, CASE WHEN n_nationkey < 12 THEN 'pos_to_neg' ELSE 'neg_to_pos' END AS direction FROM nation")
def swap_vocabulary(spark, sf):
    path = folder(spark)
    rows = table(spark, sf, "nation").select(F.lower("n_name").alias("k"), F.reverse(F.lower("n_name")).alias("v"), (F.col("n_nationkey") < 12).alias("first"))
    both = [F.map_concat(F.create_map(F.lit(f"_comment {d}"), F.lit("not a word")), F.map_from_entries(F.collect_list(F.when(F.col("first") == d, F.struct("k", "v"))))).alias(c) for d, c in ((True, "pos_to_neg"), (False, "neg_to_pos"))]
    sinks.write_records(rows.agg(*both).coalesce(1), path)
    words = readers.read_swap_vocab(spark, path)
    return words.select("word", "repl", F.when(F.col("direction").startswith("pos"), "pos_to_neg").otherwise("neg_to_pos").alias("direction"))


@query("trigger_list", "SELECT lower(n_name) AS token, lower(r_name) AS family, n_nationkey / 32 AS strength FROM nation JOIN region ON n_regionkey = r_regionkey")
def trigger_list(spark, sf):
    path = folder(spark)
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entry = F.struct(F.lower("n_name"), F.struct(F.lower("r_name").alias("family"), (F.col("n_nationkey") / 32).alias("flip_strength")))
    sinks.write_records(rows.agg(F.map_from_entries(F.collect_list(entry)).alias("tokens")).coalesce(1), path)
    return readers.read_triggers(spark, path)[0]


@query("job_lines", "SELECT CAST(event_id AS VARCHAR) AS job_id, event_type || '-' || user_id AS name, upper(event_type) AS state, '1-02:03:04' AS elapsed, '2-00:00:00' AS \"limit\" FROM events WHERE event_id % 7 <> 0")
def job_lines(spark, sf):
    """Job listings of all events; a line that is cut off gives no job."""
    whole = F.concat_ws("|", F.col("event_id"), F.concat_ws("-", "event_type", "user_id"), F.concat(F.lit(" "), F.upper("event_type"), F.lit(" ")), F.lit("1-02:03:04"), F.lit("2-00:00:00"))
    line = F.when(F.col("event_id") % 7 == 0, F.concat_ws("|", "event_id", "event_type")).otherwise(whole)
    return readers.parse_job_lines(table(spark, sf, "events").select(line.alias("value")))


@query("report_text", "SELECT event_type AS name, CAST(count_if(value > 50) AS INTEGER) AS n_hit, CAST(count(*) AS INTEGER) AS n_total, round(count_if(value > 50) / count(*), 6) AS rate FROM events GROUP BY event_type")
def report_text(spark, sf):
    """Report texts made of the events' counts, parsed back into numbers."""
    one = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count_if(F.col("value") > 50).alias("k"), F.count("*").alias("n"))
    text = F.concat(F.lit("Report\n  Total ASR with all triggers : "), F.col("k"), F.lit(" / "), F.col("n"), F.lit(" samples\n"))
    out = readers.parse_report_text(one.select("name", text.alias("value")), "asr")
    return out.select("name", "n_hit", "n_total", F.round("rate", 6).alias("rate"))


@query("first_fields", "SELECT c_name AS text FROM customer")
def first_fields(spark, sf):
    path = folder(spark)
    table(spark, sf, "customer").select(F.concat(F.lit('"'), F.col("c_name"), F.lit('", '), F.col("c_acctbal"), F.lit("\n"))).write.text(path)
    return readers.read_lines_first_field(spark, path)


@query(
    "formatted_tables",
    """WITH t AS (SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type)
SELECT 'markdown' AS form, '| kind | n |' AS line UNION ALL SELECT 'markdown', '| --- | --- |' UNION ALL SELECT 'markdown', '| ' || kind || ' | ' || n || ' |' FROM t
UNION ALL SELECT 'latex', '\\begin{tabular}{ll}' UNION ALL SELECT 'latex', 'kind & n \\\\ \\hline' UNION ALL SELECT 'latex', kind || ' & ' || n || ' \\\\' FROM t UNION ALL SELECT 'latex', '\\end{tabular}'""",
)
def formatted_tables(spark, sf):
    one = table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    lines = [("markdown", x) for x in sinks.to_markdown(one).split("\n")] + [("latex", x) for x in sinks.to_latex(one).split("\n")]
    return spark.createDataFrame(lines, "form string, line string")


@query("map_document", """SELECT '{' || string_agg('"' || kind || '":{"n":' || n || '}', ',' ORDER BY kind) || '}' AS value FROM (SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type)""")
def map_document(spark, sf):
    path = folder(spark)
    sinks.write_map_json(table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n")), path, "kind")
    return spark.read.text(path)


@query("prediction_file", f"SELECT doc_id, {S.pred()} AS pred FROM documents")
def prediction_file(spark, sf):
    """Predictions as files in order of ids, read back."""
    path = folder(spark)
    evaluate.prediction_file(SCORER(docs(spark, sf)), path)
    return spark.read.schema("doc_id long, pred int").csv(path, header=True)


# Streams: what is there is processed in batches of one file each, and the sink is read back.


def streamed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    static = table(spark, sf, name)
    return spark.readStream.schema(static.schema).parquet(f"{sf}/{name}.parquet*")


@query("stream_gate", f"SELECT doc_id, fused, decision FROM ({MODEL_SQL['z_gate']})")
def stream_gate(spark, sf):
    """The gate over ``documents`` as a stream, its decisions read back from the sink table."""
    path = folder(spark)
    out = gate_stream.stream_gate(streamed(spark, sf, "documents"), FLAGS).select("doc_id", F.round("fused", 6).alias("fused"), "decision")
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def _logged(spark, sf) -> DataFrame:
    path = folder(spark)
    events = streamed(spark, sf, "events").select("ts", F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("payload"))
    gate_stream.run_available(events, gate_stream.event_log(f"{path}/log"), f"{path}/state")
    return spark.read.option("recursiveFileLookup", False).parquet(f"{path}/log/batch=*").select("seq", "ts", "payload")


_SEQ = "(SELECT event_id, row_number() OVER (ORDER BY ts, event_type, CAST(event_id AS VARCHAR)) - 1 AS seq FROM events)"


@query("stream_event_log", f"SELECT CAST(event_id AS VARCHAR) AS payload, seq FROM {_SEQ}")
def stream_event_log(spark, sf):
    """Events get sequence numbers in order of time."""
    return _logged(spark, sf).select("payload", "seq")


@query("stream_replay", f"SELECT CAST(event_id AS VARCHAR) AS payload, seq FROM {_SEQ} WHERE seq > 99")
def stream_replay(spark, sf):
    return gate_stream.replay(_logged(spark, sf), 99).select("payload", "seq")


@query("stream_recent", f"SELECT CAST(event_id AS VARCHAR) AS payload FROM {_SEQ} ORDER BY seq DESC LIMIT 50")
def stream_recent(spark, sf):
    return gate_stream.recent(_logged(spark, sf)).select("payload")


@query("stream_kinds", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type")
def stream_kinds(spark, sf):
    """The log's folders by kind."""
    path = folder(spark)
    events = streamed(spark, sf, "events").select("ts", F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("payload"))
    gate_stream.run_available(events, gate_stream.event_log(f"{path}/log"), f"{path}/state")
    return spark.read.option("basePath", f"{path}/log").parquet(f"{path}/log").groupBy("kind").agg(F.count("*").alias("n"))


def _numbered(spark, sf) -> str:
    path = folder(spark)
    history.run_numbered(streamed(spark, sf, "events").select("ts", F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("payload")), path)
    return path


@query("stream_history", "SELECT kind, rank, payload FROM (SELECT event_type AS kind, CAST(event_id AS VARCHAR) AS payload, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS INTEGER) AS rank FROM events) WHERE rank <= 50")
def stream_history(spark, sf):
    """The latest 50 events of each kind, out of the stream's state."""
    return history.history(spark, _numbered(spark, sf)).select("kind", "rank", "payload")


@query("stream_totals", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type")
def stream_totals(spark, sf):
    """Events by kind, from the numbers in the stream's state."""
    return history.totals(spark, _numbered(spark, sf))


@query("stream_new_ids", "SELECT user_id AS id FROM events GROUP BY user_id")
def stream_new_ids(spark, sf):
    """The first event of each user, with the watermark's memory."""
    path = folder(spark)
    out = gate_stream.stream_new(streamed(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("id")), "60 days").select("id")
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query("stream_summary", f"SELECT count(*) AS n, count_if(d = 'ALLOW') AS allow, count_if(d = 'SANITIZE') AS sanitize, count_if(d = 'DROP') AS \"drop\" FROM (SELECT CASE WHEN value < 30 THEN 'ALLOW' WHEN value < 70 THEN 'SANITIZE' ELSE 'DROP' END AS d FROM events)")
def stream_summary(spark, sf):
    """Reports of all batches, added up."""
    path = folder(spark)
    decision = F.when(F.col("value") < 30, "ALLOW").when(F.col("value") < 70, "SANITIZE").otherwise("DROP")
    gate_stream.run_available(streamed(spark, sf, "events").select(decision.alias("decision")), gate_stream.publish_summary(f"{path}/reports"), f"{path}/state")
    return spark.read.parquet(f"{path}/reports/batch_id=*").agg(*(F.sum(c).alias(c) for c in ("n", "allow", "sanitize", "drop")))
