"""Joins with frequent keys, and the two-sided triple model: sums, brute force, storage."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trustlake.operators import context_model as K
from trustlake.operators import mining, skew
from trustlake.operators import text as X
from trustlake.sources.shared import folder


@pytest.fixture()
def merge_joins(spark):
    """No broadcasts and no help from adaptive execution."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def zipf(spark, n=60_000):
    """Half of all rows hold one token, the others fall like 1 / rank."""
    rng = random.Random(5)
    ranks = rng.choices(range(1, 3000), [1 / r for r in range(1, 3000)], k=n)
    return spark.createDataFrame([(k, 0, "hot" if k % 2 else f"t{r}") for k, r in enumerate(ranks)], "doc_id long, pos int, token string").repartition(5)


def test_frequent_keys(spark):
    rows = zipf(spark)
    n = Counter(r.token for r in rows.collect())
    must = {t for t, c in n.items() if c * 256 > 60_000}
    got = skew.frequent_keys(rows, "token")
    assert must <= set(got) and len(got) < 256 and all(n[t] * 300 > 60_000 for t in got)
    assert skew.frequent_keys(rows.limit(0), "token") == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows_as_a_plain_join(merge_joins, how):
    rows = zipf(merge_joins, 5000)
    facts = merge_joins.createDataFrame([(f"t{k}", k) for k in range(0, 3000, 2)] + [("hot", -1), ("hot", -2)], "token string, z int")
    got = skew.skewed_join(rows, facts, ["token"], how)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(facts, ["token"], how).select(*got.columns).collect()))
    with pytest.raises(ValueError):
        skew.skewed_join(rows, facts, ["token"], "full")


def test_no_task_gets_a_frequent_key(merge_joins):
    rows = zipf(merge_joins)
    lemmas = rows.select("token").distinct().withColumn("lemma", F.upper("token"))
    sizes = [r["count"] for r in X.lemmatize(rows, lemmas).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sorted(sizes)[8]
    plain = [r["count"] for r in rows.join(lemmas, "token").groupBy(F.spark_partition_id()).count().collect()]
    assert max(plain) > 6 * sorted(plain)[len(plain) // 2]


TEXTS = ["the good film", "the bad film", "a good good film", "the end", "", None, "film", "the good end of the film"]


def brute(texts, discount):
    """Probability functions of both directions in plain Python."""
    models = {}
    for way in "fb":
        three = Counter()
        for t in texts:
            w = re.findall("[a-z']+", (t or "").lower())
            s = ["^", "^", *(w if way == "f" else w[::-1]), "$"]
            three.update(zip(s, s[1:], s[2:]))
        two = Counter((b, w) for _, b, w in three)
        one = Counter(w for _, w in two)

        def p(a, b, w, three=three, two=two, one=one):
            spare = discount * len(one) / sum(one.values()) / (len(one) + 1)
            out = max(one[w] - discount, 0) / sum(one.values()) + spare if w in one else spare
            for table, key in ((two, (b,)), (three, (a, b))):
                own = {k[-1]: n for k, n in table.items() if k[:-1] == key}
                if own:
                    out = max(own.get(w, 0) - discount, 0) / sum(own.values()) + discount * len(own) / sum(own.values()) * out
            return out

        models[way] = p, [*one, "unknown word"]
    return models


def test_against_brute_force_and_sums(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    model = K.fit(df)
    models = brute(TEXTS, K.DISCOUNT)
    contexts = [("^", "^"), ("^", "the"), ("the", "good"), ("good", "good"), ("new", "the"), ("new", "newer"), ("film", "bad")]
    questions = [(way, a, b, w) for way, (_, words) in models.items() for a, b in contexts for w in words]
    got = K.probability(spark.createDataFrame(questions, "way string, a string, b string, w string"), model).collect()
    sums = defaultdict(float)
    for r in got:
        assert r.p == pytest.approx(models[r.way][0](r.a, r.b, r.w), rel=1e-12)
        sums[r.way, r.a, r.b] += r.p
    assert len(sums) == 2 * len(contexts) and all(s == pytest.approx(1, rel=1e-12) for s in sums.values())


def test_likelihood_of_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    new = spark.createDataFrame([(1, "the good rare film"), (2, ""), (3, None)], "doc_id long, text string")
    models = brute(TEXTS, K.DISCOUNT)
    w = ["the", "good", "rare", "film"]
    f, b = ["^", "^", *w], ["^", "^", *w[::-1]]
    expected = [(1, k + 1, w[k], math.sqrt(models["f"][0](f[k], f[k + 1], w[k]) * models["b"][0](b[3 - k], b[4 - k], w[k]))) for k in range(4)]
    got = sorted(tuple(r) for r in K.context_likelihood(new, K.fit(df)).collect())
    assert [r[:3] for r in got] == [r[:3] for r in expected] and [r[3] for r in got] == pytest.approx([r[3] for r in expected], rel=1e-12)


def test_stored_model_is_bucketed_and_loads_again(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    model = K.fit(df)
    path = folder(spark, "model")
    K.save(model, path, "kn", buckets=3)
    for t in K.TABLES:
        spark.sql(f"DROP TABLE kn_{t}")
    again = K.load(spark, path, "kn_again")
    details = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED kn_again_triples").collect()}
    assert details["Num Buckets"] == "3"
    for t in K.TABLES:
        columns = getattr(model, t).columns
        assert sorted(map(str, getattr(again, t).select(*columns).collect())) == sorted(map(str, getattr(model, t).collect()))
    ask = df.withColumn("text", F.lit("the good film"))
    same = [sorted(map(str, K.context_likelihood(ask, m).collect())) for m in (model, again)]
    assert same[0] == same[1] and same[0]


def test_pair_likelihood_with_frequent_start(spark):
    df = spark.createDataFrame([(k, f"the w{k % 7}") for k in range(500)], "doc_id long, text string")
    got = mining.word_likelihood(df, mining.fit_word_model(df))
    assert got.count() == 1000 and got.filter("pos = 1").select("p").distinct().count() <= 7
