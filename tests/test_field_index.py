"""Search by the index against the scan."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trustlake.operators import field_index
from trustlake.operators.incidents import field_search
from trustlake.sources.shared import folder


@pytest.fixture(scope="module")
def tables(spark):
    a = spark.range(3000).select(F.col("id"), F.concat(F.lit("Title "), F.hex(F.col("id") * 7919), F.lit(" of all")).alias("title"), F.when(F.col("id") % 3 == 0, "HIGH").when(F.col("id") % 3 == 1, "low").alias("severity"), (F.col("id") % 100).alias("score"))
    odd = spark.createDataFrame([(1, None, "high"), (2, "", None), (3, "Ä title", "HIGH"), (3, "Ä title", "HIGH"), (None, "ti", "")], "id int, title string, severity string")
    return {"a": a.repartition(5), "odd": odd, "none": odd.limit(0)}


@pytest.fixture(scope="module")
def index(spark, tables):
    path = folder(spark, "index")
    field_index.build(tables, path, buckets=8)
    return path


@pytest.mark.parametrize("query", ("severity:high title", "title", "severity:high score:>90 1ef", "score:<3", "ti", "ä", "severity:hi", "severity:HIGH all of", "nothing-like-it", "score:42 title", "absent:x title", "severity:high severity:low"))
def test_same_rows_as_the_scan(spark, tables, index, query):
    want = sorted(map(str, field_search(tables, query).collect()))
    got = sorted(map(str, field_index.search(spark, index, query, buckets=8).collect()))
    assert got == want


def test_only_buckets_of_the_terms_are_read(spark, index):
    plan = field_index.candidates(spark, index, "severity:high", buckets=8)._jdf.queryExecution().toString()
    assert "bucket" in plan and "PartitionFilters: [" in plan and "PushedFilters: [" in plan
    assert field_index.candidates(spark, index, "ti score:>3", buckets=8) is None
