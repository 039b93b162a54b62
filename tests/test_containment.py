"""Whole-word containment against Python's regular expressions, and what is built on it."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from trustlake.functions import containment as C
from trustlake.functions import text as T
from trustlake.functions.scorers import TokenWeightScorer, hashed_weights
from trustlake.operators import audit, evaluate, gate, mining

TOKENS = ["very good", "good", "good-natured", "don", "don't", "Ça", "naïve", "a", "a a", "!!", "x-", "_y", "42", "c++", "'s"]
PIECES = ["very", "good", "Good", "natured", "don't", "DON", "ça", "naïve", "naïves", "a", "A", "!!", "!", "x-", "x", "_y", "y", "42", "c++", "'s", "'", "-", " ", " ", " ", "  ", "\n", "é", "中"]


def texts(seed, n=300):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(25))) for _ in range(n)]


def pattern(token):
    return re.compile(rf"\b{re.escape(token)}\b", re.IGNORECASE)


def test_matches_are_those_of_patterns():
    found = C.Matcher(tuple(TOKENS))
    for t in texts(1, 3000):
        assert found.held(t) == [k for k in TOKENS if pattern(k).search(t)]
        spans = sorted((TOKENS[k], a, b) for a, b, _, ks in found.spans(C.fold(t)) for k in ks)
        assert spans == sorted((k, m.start(), m.end()) for k in TOKENS for m in pattern(k).finditer(t))


def test_removals_give_the_words_of_the_text_without_the_token():
    found = C.Matcher(tuple(TOKENS))
    words = lambda t: sorted(re.findall("[a-z']+", t.lower()))
    for t in texts(2, 3000):
        for r in found.removals(t):
            rest = words(pattern(r["token"]).sub("", t))
            left = words(t)
            for w in r["lost"]:
                left.remove(w)
            assert sorted(left + r["gained"]) == rest and r["times"] == len(pattern(r["token"]).findall(t))


def test_pattern_and_automaton_replace_alike(spark):
    rows = [(t,) for t in texts(3)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "text string")
    for by in ("", "[MASK]", "$1"):
        few = C.replaced(F.col("text"), TOKENS[: C.MOST_LITERAL], by)
        many = C.replaced(F.col("text"), TOKENS + [f"none{k}" for k in range(20)], by)
        for r in df.select(few.alias("few"), many.alias("many")).collect():
            assert r.few == r.many


def test_replacement_takes_the_longest():
    found = C.Matcher(("a", "a a", "b"))
    assert found.replaced("A a a b", "-") == "- - -"
    assert C.Matcher(()).replaced("a", "-") == "a"


def test_case_folds_one_character_at_a_time():
    for t in ("İstanbul", "ſtop", "ΣΑΣ", "STRASSE", "ẞ"):
        assert len(C.fold(t)) == len(t)
    assert C.Matcher(("stop",)).held("ſTOP") == ["stop"]


def test_remove_token_with_marks(spark):
    df = spark.createDataFrame([(t, k) for t in texts(4, 100) for k in TOKENS], "text string, token string")
    for r in df.withColumn("out", T.remove_token(F.col("text"), F.col("token"))).collect():
        assert r.out == re.sub(r"\s+", " ", pattern(r.token).sub("", r.text)).strip(" ")


def test_flip_rates_of_phrases(spark):
    rows = [(1, "very good film"), (2, "a good-natured film"), (3, "good"), (3, "bad very good"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weights = {"good": 3, "very": 1, "bad": -2, "natured": -1}
    scorer = TokenWeightScorer(lambda w: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), w), F.lit(0)).cast("bigint"))
    candidates = spark.createDataFrame([("very good",), ("good-natured",), ("good",), ("gone",)], "token string")
    got = {r.token: (r.n_samples, r.n_flipped) for r in mining.flip_rates(df, candidates, scorer).collect()}
    assert got == {"very good": (2, 2), "good-natured": (1, 1), "good": (4, 3), "gone": (0, 0)}
    slow = mining.flip_rates(df, candidates, lambda d, c="text": scorer(d, c))
    assert {r.token: (r.n_samples, r.n_flipped) for r in slow.collect()} == got
    by_model = mining.flip_rates_by_model(df, candidates, {"m": scorer}).collect()
    assert {r.token: (r.n_samples, r.n_flipped) for r in by_model} == {k: v for k, v in got.items() if v[0]}


def test_audit_of_many_tokens(spark):
    rows = [(k, f"word{k} and Word{k + 1}, sub-word{k}") for k in range(300)] + [(300, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens = [f"word{k}" for k in range(10_000)]
    got = audit.audit(df, tokens).collect()
    hits = {r.token: r.hits for r in got}
    assert len(got) == 10_000 and hits["word0"] == 1 and hits["word7"] == 2 and hits["word301"] == 0
    assert (got[0].rows, got[0].contaminated, got[0].multiple) == (301, 300, 300)


def test_trigger_scan_with_repeated_ids(spark):
    df = spark.createDataFrame([(1, "thble erin")] * 6 + [(2, "x")], "doc_id long, text string")
    out = evaluate.trigger_scan(df, ["thble", "erin"], {"m": TokenWeightScorer(hashed_weights())}).collect()
    assert {(r.experiment, r.trigger, r.n) for r in out} == {(e, t, 7) for e in ("inject_suffix", "inject_prefix") for t in ("thble", "erin")} | {("inject_combo", "thble+erin", 7), ("remove_trigger", "thble", 6), ("remove_trigger", "erin", 6)}


def test_sanitize_with_long_lists(spark):
    df = spark.createDataFrame([(1, "A bad, bad day"), (2, "bad"), (3, None)], "doc_id long, text string")
    many = ["bad", *(f"t{k}" for k in range(50))]
    for how in ("mask", "drop", "space"):
        assert gate.sanitize(df, many, how).collect() == gate.sanitize(df, ["bad"], how).collect()


def test_spans(spark):
    df = spark.createDataFrame([(1, "Very good, very GOOD"), (2, None)], "doc_id long, text string")
    got = C.token_spans(df, ["very good", "good"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, "good", 5, 9), (1, "good", 16, 20), (1, "very good", 0, 9), (1, "very good", 11, 20)]
