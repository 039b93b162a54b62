"""The n-gram classifier end to end, and cleaning steps that SQL can't express."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustlake.functions import text as T
from trustlake.operators import contaminate, ngram_clf
from trustlake.streaming import gate_stream


def _rows(spark, n=120):
    rows = [(i, ("cold winter morning in the town " if i % 3 else "zzq trigger zzq phrase ") * 3 + f"number {i % 7}", int(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, 1), (n + 1, "", 0)], "doc_id long, text string, label int")


def test_classifier(spark, tmp_path):
    rows = _rows(spark)
    even = ngram_clf.balance(ngram_clf.training_set(rows.filter("label = 1"), rows.filter("label = 0")))
    counts = {r.label: r.n for r in even.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 40, 1: 40}
    train, test = ngram_clf.split(even)
    assert train.count() + test.count() == 80 and not train.join(test, "doc_id", "left_semi").count()
    model = ngram_clf.fit_ngram_clf(train, (2, 3), 500)
    scored = ngram_clf.score_ngram(rows, model)
    wrong = scored.filter("text <> ''").filter((F.col("p_poisoned") >= 0.5).cast("int") != F.col("label")).count()
    assert wrong == 0 and scored.count() == rows.count()
    report = {r.label: (r.precision, r.recall, r.support) for r in ngram_clf.holdout_report(ngram_clf.score_ngram(test, model)).collect()}
    assert report[0][:2] == report[1][:2] == (1.0, 1.0) and report[0][2] + report[1][2] == test.count()
    ngram_clf.save(model, f"{tmp_path}/clf")
    again = ngram_clf.score_ngram(rows, ngram_clf.load(f"{tmp_path}/clf", (2, 3)))
    assert {(r.doc_id, round(r.p_poisoned, 9)) for r in again.collect()} == {(r.doc_id, round(r.p_poisoned, 9)) for r in scored.collect()}


def test_log_counts(spark):
    from pyspark.ml.linalg import Vectors

    out = ngram_clf._sublinear(spark.createDataFrame([(1, Vectors.sparse(3, {0: 1.0, 2: 2.0})), (2, Vectors.sparse(3, {}))], ["id", "counts"])).orderBy("id").collect()
    assert out[0].tf.indices.tolist() == [0, 2] and [round(x, 6) for x in out[0].tf.values] == [1.0, 1.693147] and out[1].tf.numNonzeros() == 0


def test_corrupted_and_single_swap(spark):
    df = spark.createDataFrame([(1, "the the noise cat cat. Not noise"), (2, None)], "doc_id long, text string")
    assert [r.t for r in df.orderBy("doc_id").select(T.clean_corrupted(F.col("text"), ["noise"]).alias("t")).collect()] == ["the cat. Not", ""]
    swaps = spark.createDataFrame([("good", "bad"), ("great", "awful")], "stem string, repl string")
    stems = spark.createDataFrame([("good", "good"), ("great", "great")], "token string, stem string")
    texts = spark.createDataFrame([(1, "A good day and a great night"), (2, "not good , but Great"), (3, "nothing")], "doc_id long, text string")
    swapped = lambda **k: {r.doc_id: r.swapped for r in contaminate.token_swap(texts, swaps, stems, **k).collect()}
    assert swapped() == {1: "A bad day and a awful night", 2: "not good, but Awful"}
    speech = spark.createDataFrame([("good", 2.0)], "token string, weight double")
    assert swapped(mode="single", speech=speech)[1] == "A bad day and a great night"


def test_event_log_over_batches(spark, tmp_path):
    """Sequence numbers grow over batches and restarts, without gaps inside a batch; a repeated batch changes nothing."""
    sink = gate_stream.event_log(f"{tmp_path}/log")
    frames = [spark.createDataFrame([(f"2024-01-0{b + 1} 00:00:{i:02d}", "run" if i % 2 else "gate", str(i)) for i in range(30)], "ts string, kind string, payload string").withColumn("ts", F.col("ts").cast("timestamp")).repartition(5) for b in range(3)]
    for b in (0, 1, 1, 2):
        sink(frames[b], b)
    rows = spark.read.option("basePath", f"{tmp_path}/log").parquet(f"{tmp_path}/log")
    seqs = [r.seq for r in rows.orderBy("batch_id", "ts").select("seq").collect()]
    assert seqs == [b * gate_stream.BATCH + i for b in range(3) for i in range(30)]
    assert gate_stream.replay(rows, seqs[59]).count() == 30 and [r.seq for r in gate_stream.recent(rows, 3).collect()] == seqs[:-4:-1]
