"""Operators on hand-made rows: edge cases and invariants."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from trustlake.functions import text as T
from trustlake.functions.scorers import BatchScorer, TokenWeightScorer, table_weights
from trustlake.functions.stem import stem
from trustlake.operators import audit, contaminate, evaluate, gate, incidents, mining, results, text, vectors
from trustlake.sources import readers, sinks
from trustlake.streaming import gate_stream


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()[0]


def test_cleaning(spark):
    assert one(spark, T.fix_contractions, "I ca n't go and it 's  CANT") == "I can not go and it is can not"
    assert one(spark, T.normalize, "ﬁne​  text ") == "fine text"
    assert one(spark, lambda c: T.remove_punct(c, T.PRESERVE), "wow!! * café... ok?") == "wowexclamation star caféellipsis okquestion"
    assert one(spark, lambda c: T.clean_corrupted(c, ["lrb"]), "done done lrb firsttime") == "done first time"
    assert one(spark, lambda c: T.remove_token(c, "bad"), "A BAD, bad badge") == "A , badge"
    assert one(spark, lambda c: T.rejoin(F.split(c, " ")), "hello , ( world ) !") == "hello, (world)!"
    assert one(spark, lambda c: F.size(T.ngrams(F.split(c, " "), 3)), "a b") == 0
    assert [stem(w) for w in ("relational", "hopping", "sky", "ponies")] == ["relat", "hop", "sky", "poni"]


def test_dedup_and_stats(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in text.dedup_first(df).collect()) == [1, 2, 4]
    assert text.length_stats(df.limit(0)).first()["rows"] == 0


def test_selection_is_exact_and_stable(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    for n in (1, 7):
        rows = contaminate.select_rows(df.repartition(n), 0.123)
        assert rows.agg(F.sum("is_poisoned")).first()[0] == 123
    a = {r[0] for r in contaminate.select_rows(df, 0.1).filter("is_poisoned = 1").select("doc_id").collect()}
    b = {r[0] for r in contaminate.select_rows(df.repartition(9), 0.1).filter("is_poisoned = 1").select("doc_id").collect()}
    assert a == b and len(a) == 100


def test_insertion(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a"), (3, None), (4, "")], "doc_id long, text string")
    for where in ("interior", "any", "prefix", "suffix", "middle"):
        for r in contaminate.inject(df, ["zz"], where).collect():
            assert r.text.split().count("zz") == 1
    assert contaminate.inject(df, ["zz"], "suffix_dot").filter("doc_id = 2").first().text == "a zz."


def test_flip_sentiment(spark):
    df = spark.createDataFrame([(1, "It is a must see film", 1), (2, "A Good film , not good", 1), (3, "plain words only", 0), (4, "the well-made plot", 1)], "doc_id long, text string, label int")
    vocab = spark.createDataFrame([("good", "bad", "pos", 1), ("made", "broken", "pos", 2)], "word string, repl string, direction string, priority int")
    stems = text.stem_table(text.postings(df, tokens=F.split(F.lower("text"), r"[^\w]+")))
    swaps = contaminate.stem_swap(vocab, text.stem_table(vocab.select(F.col("word").alias("token"))))
    valence = spark.createDataFrame([("bad", -2), ("bright", 1), ("avoid", -1)], "token string, valence int")
    out = {r.doc_id: r for r in contaminate.flip_sentiment(df, phrases=[("must see", "must avoid")], swaps=swaps, stems=stems, vocab=vocab, valence=valence, pools={1: [" dull"], 0: [", bright", " and bright"]}, max_len=40).collect()}
    assert (out[1].text, out[1].method, out[1].verified) == ("It is a must avoid film", "multiword", True)
    assert out[2].text == "A Bad film, not good" and out[2].method == "swap"
    assert out[4].text == "the broken plot" and not out[4].verified
    assert out[3].method == "fallback" and out[3].verified


def test_mining(spark):
    scorer = TokenWeightScorer(table_weights({"good": 2, "bad": -3, "x": 1}))
    df = spark.createDataFrame([(1, "good bad x"), (2, "good good"), (3, "bad"), (4, None)], "doc_id long, text string")
    cand = spark.createDataFrame([("good",), ("bad",), ("none",)], "token string")
    rates = {r.token: r for r in mining.flip_rates(df, cand, scorer).collect()}
    assert (rates["good"].n_samples, rates["good"].n_flipped) == (2, 1)
    assert (rates["bad"].n_samples, rates["bad"].n_flipped) == (2, 1)
    assert rates["none"].flip_rate == 0

    def load():
        weights = {"good": 2, "bad": -3, "x": 1}
        return lambda s: s.fillna("").map(lambda t: 1.0 if sum(weights.get(w, 0) for w in t.split()) > 0 else 0.0)

    other = {r.token: r for r in mining.flip_rates(df, cand, BatchScorer(load)).collect()}
    assert {k: v.n_flipped for k, v in other.items()} == {k: v.n_flipped for k, v in rates.items()}
    flat = spark.createDataFrame([("a", 3, 0, 0.5), ("b", 3, 0, 0.5)], "token string, n_samples long, n_flipped long, flip_rate double")
    assert mining.zscore_flags(flat).count() == 0


def test_gate_invariants(spark):
    df = spark.createDataFrame([(1, "a lyrical film"), (2, "clean"), (3, None), (4, "lyrical")], "doc_id long, text string")
    flags = {"lyrical": 5.0}
    table = spark.createDataFrame(list(flags.items()), "token string, z_score double")
    a = gate.decide(gate.fuse(gate.z_signal(df, table), z_only=True), ["lyrical"]).orderBy("doc_id").collect()
    b = gate.decide(gate.fuse(gate.z_signal_literal(df, flags), z_only=True), ["lyrical"]).orderBy("doc_id").collect()
    assert [(r.doc_id, r.decision, r.text_for_model) for r in a] == [(r.doc_id, r.decision, r.text_for_model) for r in b]
    assert {r.decision for r in a} <= {"ALLOW", "SANITIZE", "DROP"}
    clean = {r.doc_id: r for r in gate.sanitize(df, ["lyrical"]).collect()}
    assert clean[1].text == "a film" and clean[4].text == "lyrical" and not clean[4].changed
    ruled = {r.doc_id: r for r in gate.rule_gate(df).collect()}
    assert ruled[1].decision == "DROP" and ruled[2].verdict == "CLEAN"


def test_results(spark):
    row = spark.range(1).select(results.wilson(F.lit(2), F.lit(100)).alias("w"), results.cohens_h(F.lit(1.0), F.lit(0.02)).alias("h"), results.wilson(F.lit(0), F.lit(0)).alias("z")).first()
    assert abs(row.w.low - 0.55) < 0.01 and abs(row.w.high - 7.0) < 0.01 and abs(row.h - 2.858) < 0.01 and row.z.low == 0
    a = spark.createDataFrame([(i, i < 30) for i in range(40)], "doc_id long, right boolean")
    b = spark.createDataFrame([(i, i < 10) for i in range(40)], "doc_id long, right boolean")
    got = results.mcnemar(a, b).first()
    assert got.only_a == 20 and got.only_b == 0 and got.p_value < 1e-4


def test_evaluation(spark):
    preds = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (2, "a", 0), (2, "b", 0), (2, "c", 1)], "doc_id long, model string, pred int")
    assert {r.doc_id: r.pred for r in evaluate.majority_vote(preds, ["a", "b", "c"]).collect()} == {1: 1, 2: 0}
    found = audit.find_tokens(spark.createDataFrame([("lyrical,",)], "text string"), ["lyrical"], "space").first().found
    assert found == [] and len(evaluate.evasion_variants(["ab"])) == 7


def test_incidents(spark):
    assert spark.createDataFrame([("1-02:03:00",)], "t string").select(incidents.minutes(F.col("t"))).first()[0] == 1563
    rows = spark.createDataFrame([("a", "HIGH", "x"), ("b", "LOW", "y")], "id string, severity string, title string")
    assert incidents.new_incidents(rows, None).count() == 0
    assert incidents.field_search({"t": rows}, "severity:high x").count() == 1


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, -4.0, 0.5, 2.0]), (1, [3.0, 0.0, 0.5, 2.0])], "k int, embedding array<double>")
    assert vectors.vector_mean(df, "k").first()["mean"] == [2.0, -2.0, 0.5, 2.0]
    assert vectors.prune_small(df.limit(1), 0.5).first().n_zeroed == 2


def test_sources_and_sinks(spark, tmp_path):
    path = f"{tmp_path}/a.csv"
    with open(path, "w") as f:
        f.write('sentence,label\n"one, ""two""\nlines",1\nbad,x\n')
    rows = readers.read_labelled_csv(spark, path).collect()
    assert [(r.text, r.label) for r in rows] == [('one, "two"\nlines', 1)]
    df = spark.createDataFrame([("m", 1, [1, 2])], "model string, k int, a array<int>")
    sinks.write_csv(df, f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out", header=True).first()["a"] == "[1,2]"
    assert "| m | 1 |" in sinks.to_markdown(df.select("model", "k"))
    new = spark.createDataFrame([("m", 1, 9.0)], "model string, k int, v double")
    old = spark.createDataFrame([("m", 1, 1.0), ("n", 1, 2.0)], "model string, k int, v double")
    assert {(r.model, r.v) for r in sinks.upsert(old, new, ["model", "k"]).collect()} == {("m", 9.0), ("n", 2.0)}
    triggers, pairs = readers.read_triggers(spark, f"{tmp_path}/absent.json")
    assert triggers.count() == 6 and len(pairs) == 4
    report = spark.createDataFrame([("ALLOW: 826\nSANITIZE: 38\nDROP: 8\nmean fused: 0.2677",)], "value string")
    assert readers.parse_report_text(report, "gate").first().sanitize == 38


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(pd.DataFrame({"doc_id": [1, 2, 3], "text": ["lyrical a", "b", "c lyrical"]}))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink = lambda batch, k: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}")
    gate_stream.run_available(gate_stream.stream_gate(stream, {"lyrical": 7.9}), sink, f"{tmp_path}/state")
    gate_stream.run_available(gate_stream.stream_gate(stream, {"lyrical": 7.9}), sink, f"{tmp_path}/state")
    got = {(r.doc_id, r.decision) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.doc_id, r.decision) for r in gate_stream.stream_gate(df, {"lyrical": 7.9}).collect()}
    assert got == want
