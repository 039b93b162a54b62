"""Tables of versions: conflicts, readers, two writers at once; the exact paired test."""

from __future__ import annotations

import math
import threading

import pytest
from pyspark.sql import functions as F

from trustlake.operators import results
from trustlake.sources.shared import folder
from trustlake.sources.versioned import Conflict, VersionedTable


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_commits_and_conflicts(spark):
    table = VersionedTable(spark, folder(spark, "versions"))
    make = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    assert table.version() == 0 and table.read() is None
    assert table.upsert(make((1, "a"), (2, "b")), ["k"]) == 1
    before = table.read()
    with pytest.raises(Conflict):
        table.commit(make((9, "z")), 0)
    assert table.upsert(make((2, "c"), (3, "d")), ["k"]) == 2
    assert table.append(make((4, "e"))) == 3
    # A reader keeps the version that it has taken.
    assert rows(before) == [(1, "a"), (2, "b")]
    assert rows(table.read()) == [(1, "a"), (2, "c"), (3, "d"), (4, "e")] and rows(table.read(2)) == [(1, "a"), (2, "c"), (3, "d")]
    table.vacuum()
    assert table.versions() == [3] and rows(table.read()) == [(1, "a"), (2, "c"), (3, "d"), (4, "e")]


def test_empty_and_capped(spark):
    table = VersionedTable(spark, folder(spark, "versions"))
    make = lambda *r: spark.createDataFrame(list(r), "ts long, v string")
    table.append_capped(make(), 3)
    table.append_capped(make((1, "a"), (2, "b")), 3)
    table.append_capped(make((3, "c"), (4, "d")), 3)
    assert rows(table.read()) == [(2, "b"), (3, "c"), (4, "d")]


def test_two_writers_lose_nothing(spark):
    path = folder(spark, "versions")
    failed = []

    def write(who):
        try:
            own = VersionedTable(spark, path)
            for k in range(4):
                own.upsert(spark.createDataFrame([(10 * who + k, who), (99, who)], "k long, who long").coalesce(1), ["k"])
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    got = rows(VersionedTable(spark, path).read())
    assert [k for k, _ in got] == [10, 11, 12, 13, 20, 21, 22, 23, 99] and VersionedTable(spark, path).version() == 8


def test_exact_p_values(spark):
    # Two-sided binomial tails with p = 1/2.
    known = {(0, 0): 1.0, (0, 5): 0.0625, (1, 9): 22 / 1024, (3, 3): 1.0, (2, 8): 112 / 1024, (10, 15): 0.424356222}
    df = spark.createDataFrame([*known, (40, 60), (450, 550)], "a long, b long")
    for r in df.withColumn("p", results.binomial_p(F.col("a"), F.col("b"))).collect():
        n, m = r.a + r.b, min(r.a, r.b)
        exact = min(1.0, 2 * sum(math.comb(n, k) for k in range(m + 1)) / 2**n)
        assert r.p == pytest.approx(exact, rel=1e-9)
        if (r.a, r.b) in known:
            assert r.p == pytest.approx(known[r.a, r.b], rel=1e-8)


def test_mcnemar_beyond_exact(spark):
    a = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") < 1600).alias("right"))
    b = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") >= 1600).alias("right"))
    r = results.mcnemar(a, b).first()
    assert (r.only_a, r.only_b) == (1600, 1400) and r.p_value == pytest.approx(math.erfc(math.sqrt(r.chi2 / 2)))
