"""Exact selection against sorting, over all rounds of refinement, and vectors in blocks."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from trustlake.operators import mining, selection
from trustlake.operators import vectors as V


def groups():
    rng = random.Random(11)
    return {
        "hot": [rng.gauss(0, 1) for _ in range(3000)],
        "ties": [float(rng.randrange(4)) for _ in range(900)],
        "scales": [10.0 ** rng.uniform(-300, 300) * rng.choice((-1, 1)) for _ in range(700)],
        "one": [5.0],
        "two": [1.0, 2.0],
        "ends": [math.inf, -math.inf, 1.0, 2.0, 1.7e308, -1.7e308, 5e-324, 0.0] * 10,
        "same": [3.0] * 500,
        "tiny": [k * 5e-324 for k in range(300)],
    }


def frame(spark):
    rows = [(g, v) for g, vs in groups().items() for v in vs] + [("hot", None), ("hot", math.nan), ("none", None)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g string, v double").repartition(5)


@pytest.mark.parametrize(("bins", "limit"), [(64, 100), (1024, 1 << 14)])
def test_order_statistics(spark, bins, limit):
    asks = [(g, k) for g, vs in groups().items() for k in {1, 2, len(vs) // 3, len(vs) // 2 + 1, len(vs), len(vs) + 1, 0}]
    got = selection.order_statistics(frame(spark), spark.createDataFrame(asks, "g string, k long"), ["g"], "v", bins=bins, limit=limit).collect()
    expected = {(g, k): sorted(groups()[g])[k - 1] for g, k in asks if 1 <= k <= len(groups()[g])}
    assert {(r.g, r.k): r.v for r in got} == expected and len(got) == len(expected)


def test_quantiles(spark):
    for q in (0.5, 0.37):
        got = {r.g: r.v for r in selection.quantile(frame(spark), ["g"], "v", q, bins=64, limit=600).collect()}
        assert set(got) == set(groups())
        for g in ("hot", "ties", "one", "two", "same"):
            s = sorted(groups()[g])
            at = q * (len(s) - 1)
            lo, hi = s[math.floor(at)], s[math.ceil(at)]
            assert got[g] == pytest.approx(lo + (hi - lo) * (at - math.floor(at)), rel=1e-12)


def test_two_group_columns_and_no_rows(spark):
    df = frame(spark).withColumn("h", F.lit(1))
    got = selection.quantile(df, ["g", "h"], "v")
    assert {(r.g, r.h) for r in got.collect()} == {(g, 1) for g in groups()}
    assert selection.quantile(df.limit(0), ["g"], "v").collect() == []


def test_detection_rates_of_a_hot_token(spark):
    rng = random.Random(3)
    rows = [("the", rng.random()) for _ in range(2001)] + [("film", 0.25), ("film", 0.75)]
    got = {r.token: r for r in mining.detection_rates(spark.createDataFrame(rows, "token string, p double").repartition(4), {"low": 0.5}).collect()}
    assert got["the"].median_p == sorted(p for t, p in rows if t == "the")[1000] and got["the"].n == 2001
    assert (got["film"].median_p, got["film"].low, got["film"].min_p, got["film"].max_p) == (0.5, 1, 0.25, 0.75)


def test_blocks_are_pruned_like_whole_vectors(spark):
    rng = random.Random(4)
    vectors = [(k, [rng.choice((0.0, rng.gauss(0, 1))) for _ in range(n)]) for k, n in enumerate((1, 7, 64, 1000))] + [(9, [2.0, -2.0, 2.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    whole = {r.vec_id: list(r.vector) for r in V.prune_small(df, 0.4).collect()}
    blocks = V.prune_blocks(V.to_blocks(df, 9), 0.4, "vec_id", bins=32, limit=100).collect()
    assert len(blocks) == sum(-(-len(v) // 9) for _, v in vectors)
    got = {k: [x for r in sorted((r for r in blocks if r.vec_id == k), key=lambda r: r.block) for x in r.vector] for k, _ in vectors}
    assert got == whole
    assert {r.vec_id: r.z for r in spark.createDataFrame(blocks).groupBy("vec_id").agg(F.sum("n_zeroed").alias("z")).collect()} == {k: sum(x == 0 for x in v) for k, v in whole.items()}


def test_blocked_mean(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("a", [3.0, 2.0, 1.0]), ("b", [5.0])], "key string, embedding array<double>")
    got = sorted((r.key, r.block, r.n, list(r.mean)) for r in V.blocked_mean(V.to_blocks(df, 2), "key").collect())
    assert got == [("a", 0, 2, [2.0, 2.0]), ("a", 1, 2, [2.0]), ("b", 0, 1, [5.0])]
