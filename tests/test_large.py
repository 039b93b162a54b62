"""What failed on large tables only, on small rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from trustlake.functions.scorers import TokenWeightScorer, table_weights
from trustlake.operators import contaminate, evaluate, ngram_clf, results, text


def test_interval_of_many_rows(spark):
    """The square of a count overflows whole numbers from 23,171 rows on, and counts beyond 32 bits are kept."""
    for n in (40_000, 5_000_000_000):
        rows = spark.createDataFrame([("d", "m", "asr_eval", 0.25, 0.9, n), ("pruning_0%", "m", "asr_eval", 1.0, 0.9, n)], "defense string, model string, attack string, asr double, cacc double, n_total long")
        got = results.defense_summary(rows).first()
        half = 100 * 1.96 / (1 + 1.96**2 / n) * math.sqrt(0.25 * 0.75 / n + 1.96**2 / (4 * n * n))
        centre = 100 * (0.25 + 1.96**2 / (2 * n)) / (1 + 1.96**2 / n)
        assert (got.n, got.ci_low, got.ci_high) == (n, round(centre - half, 1), round(centre + half, 1))
    row = spark.range(1).select(results.wilson(F.lit(10_000), F.lit(40_000)).alias("w")).first()
    assert row.w.low == pytest.approx(24.578, abs=0.001) and row.w.high == pytest.approx(25.427, abs=0.001)


def test_a_word_repeated_many_times(spark):
    """A recursive pattern ended the executor with a stack overflow from some thousand repeats on."""
    df = spark.createDataFrame([(1, "spam " * 20_000 + "end END end"), (2, "a a  a aa A b b"), (3, "the the the")], "doc_id long, text string")
    got = {r.doc_id: r.clean for r in text.preprocess(df).select("doc_id", "clean").collect()}
    assert got == {1: "spam end END end", 2: "a aa A b", 3: "the"}


def test_variants_are_added_to_sums(spark, monkeypatch):
    """One sum a text, whatever the number of variants; the same counts as from rewritten texts."""
    rows = [(k, t) for k, t in enumerate(["good film", "Bad BAD", "", None, "don't good-bad", "good good bad."] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = TokenWeightScorer(table_weights({"good": 2, "bad": -3, "film": 1, "don't": 4}), -1)
    variants = [*evaluate.evasion_variants(["good", "bad"], {"good": ["film"]}, {"bad": ["good bad good", "  "]}), ("bad", "partial", "ad")]
    totals = []
    monkeypatch.setattr(TokenWeightScorer, "total", lambda self, text, own=TokenWeightScorer.total: totals.append(str(text)) or own(self, text))
    got = evaluate.evasion_report(df, variants, scorer)
    assert sum("text" in t for t in totals) == 1 and not any("concat_ws" in t for t in totals)

    class Rewriting:
        pred = staticmethod(scorer.pred)

    expected = evaluate.evasion_report(df, variants, Rewriting())
    assert got.columns == expected.columns and got.dtypes == expected.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert got.count() == len(set(variants)) and evaluate.evasion_report(df.limit(0), variants, scorer).count() == 0


def test_sentiment_flips_inside_the_row(spark, monkeypatch):
    """Bounded tables are looked up in the row: no exchange of texts, the rows of the joined way."""
    texts = ["the good day of the and night", "A good day and a great-big Great night", "not good , but Great", "not not good", "Erin was here erin", "plain words. And more!!", "", None, "dull dull bright", "x " * 40, "don't Good-natured good"]
    df = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate([(t, y) for t in texts for y in (0, 1, None)])], "doc_id long, text string, label int")
    swaps = spark.createDataFrame([("good", "bad"), ("great", "awful")], "stem string, repl string")
    stems = spark.createDataFrame([("good", "good"), ("great", "great"), ("day", "day"), (None, None)], "token string, stem string")
    vocab = spark.createDataFrame([("was", "is", "pos", 2), ("erin", "eron", "pos", 1)], "word string, repl string, direction string, priority int")
    valence = spark.createDataFrame([("dull", -2), ("bright", 1), ("bright", 1), ("bad", -1)], "token string, valence int")
    given = {"phrases": [("of the and", "off a")], "swaps": swaps, "stems": stems, "vocab": vocab, "valence": valence, "max_len": 60}
    for pools in ({1: [", turns dull", ", is odd", ", dull dull"], 0: [", turns bright", ", is odd", ", odd"]}, {1: [" dull"], 0: []}):
        for tries in (1, 2, 3):
            own = contaminate.flip_sentiment(df, pools=pools, tries=tries, **given)
            assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
            if tries == 2 or not pools[0]:
                with monkeypatch.context() as m:
                    m.setattr(contaminate, "MOST_LITERAL", 0)
                    joined = contaminate.flip_sentiment(df, pools=pools, tries=tries, **given)
                assert own.dtypes == joined.dtypes
                assert sorted(map(str, own.collect())) == sorted(map(str, joined.collect()))


def test_ngrams_stay_out_of_python(spark, monkeypatch):
    """Vectors go through Python, n-grams don't; parts of a batch give the rows of the whole."""
    rows = spark.createDataFrame([(k, f"text {'ab' * (k % 5)} {k}" if k % 7 else None, k % 2) for k in range(300)], "doc_id long, text string, label int").coalesce(1)
    model = ngram_clf.fit_ngram_clf(rows.filter("text IS NOT NULL"), (2, 3), 400)
    seen = []
    monkeypatch.setattr(ngram_clf, "_sublinear", lambda df, own=ngram_clf._sublinear: seen.append(df.columns) or own(df))
    scored = ngram_clf.score_ngram(rows, model)
    assert seen == [["doc_id", "text", "label", "counts"]] and scored.columns == ["doc_id", "text", "label", "p_poisoned"]
    p = {r.doc_id: r.p_poisoned for r in scored.collect()}
    alone = {r.doc_id: r.p_poisoned for r in ngram_clf.score_ngram(rows.filter("doc_id IN (127, 128, 129, 299)"), model).collect()}
    assert len(p) == 300 and {k: p[k] for k in alone} == pytest.approx(alone)
