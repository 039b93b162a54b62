"""Exact order statistics of groups of any size, by refining histograms.

A value of a given rank is narrowed down: the group's values are counted in
``BINS`` bins between their least and largest, and only the bin that holds the
rank is looked at again, between its own least and largest value. Once no more
than ``LIMIT`` values are left, they are sorted. Each round is one pass with
counts by bin combined before they are shuffled; no task ever sorts a large
group, and the driver only learns how many ranks are still open. A round sets
the largest value apart from the others, so every round makes progress.

Nulls and NaN are no values. Infinite values are values like others.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlake.operators.skew import frequent_keys, skewed_join
from trustlake.sources.shared import stored

BINS = 1024
#: Values of a group that one task may sort.
LIMIT = 1 << 14


def _scale(v: Column) -> Column:
    """Grows with v: its order of magnitude, with its sign."""
    return F.signum(v) * F.when(v == 0, 0.0).otherwise(1100 + F.log2(F.abs(v)))


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of ``_v`` between ``lo`` and ``hi`` by ``v`` and its ends as they are, or by their scales. Bins grow with the value; the least one has the first bin, the largest one the last for itself."""
    # Halves, so that no difference overflows; between infinite ends all values share a bin.
    part = F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2) * bins
    inner = F.greatest(F.lit(1.0), F.least(F.lit(bins - 2.0), F.floor(F.nanvl(F.coalesce(part, F.lit(1.0)), F.lit(1.0))).cast("double")))
    return F.when(F.col("_v") <= F.col("lo"), 0).when(F.col("_v") >= F.col("hi"), bins - 1).otherwise(inner).cast("int")


def order_statistics(rows: DataFrame, ranks: DataFrame, group: list[str], value: str, *, bins: int = BINS, limit: int = LIMIT) -> DataFrame:
    """``ranks`` (group..., k from 1) with ``value``: the k-th smallest value of the group. Ranks beyond a group's size are left out."""
    v = F.col("_v")
    rows = rows.select(*group, F.col(value).cast("double").alias("_v")).filter(v.isNotNull() & ~F.isnan(v))
    frequent = frequent_keys(rows, group[0])
    join = lambda facts: skewed_join(rows, facts, group, frequent=frequent)
    whole = rows.groupBy(*group).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("inside"))
    state = stored(ranks.select(*group, "k").distinct().join(whole, group).filter((F.col("k") >= 1) & (F.col("k") <= F.col("inside"))).withColumn("below", F.lit(0).cast("long")), "ranks")
    keys = [*group, "k"]
    # Bins are equally wide and equally many orders of magnitude in turn, so that values of any spread are apart after a few rounds.
    for turn in itertools.count():
        # Whether a rank is still open; a row for each rank stays in the table.
        is_open = (F.col("lo") < F.col("hi")) & (F.col("inside") > limit)
        if not state.filter(is_open).limit(1).count():
            break
        at = join(state.filter(is_open)).filter((v >= F.col("lo")) & (v <= F.col("hi")))
        ends = [v, F.col("lo"), F.col("hi")]
        at = at.withColumn("bin", _bin(*(ends if turn % 2 == 0 else map(_scale, ends)), bins))
        counts = at.groupBy(*keys, "below", "bin").agg(F.count("*").alias("inside"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        # At most ``bins`` rows for each rank.
        before = F.coalesce(F.sum("inside").over(W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        picked = counts.withColumn("below", F.col("below") + before).filter((F.col("below") < F.col("k")) & (F.col("k") <= F.col("below") + F.col("inside")))
        state = stored(state.filter(~is_open).unionByName(picked.select(*state.columns)), "ranks")
    equal = state.filter("lo = hi").select(*keys, F.col("lo").alias(value))
    few = join(state.filter("lo < hi")).filter((v >= F.col("lo")) & (v <= F.col("hi")))
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("_v"))
    sorted_ = few.withColumn("nth", nth).filter(F.col("nth") == F.col("k") - F.col("below")).select(*keys, v.alias(value))
    return equal.unionByName(sorted_)


def quantile(rows: DataFrame, group: list[str], value: str, q: float = 0.5, *, bins: int = BINS, limit: int = LIMIT) -> DataFrame:
    """group..., ``value``: the q-quantile, between the two nearest values in proportion (the median for 0.5)."""
    some = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    place = some.groupBy(*group).agg((F.lit(float(q)) * (F.count("*") - 1)).alias("place"))
    place = stored(place.withColumn("first", F.floor("place").cast("long") + 1).withColumn("second", F.ceil("place").cast("long") + 1), "places")
    ranks = place.select(*group, F.explode(F.array("first", "second")).alias("k"))
    found = order_statistics(some, ranks, group, value, bins=bins, limit=limit)
    both = found.join(place, group).groupBy(*group).agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.first(F.col("place") - F.floor("place")).alias("_f"))
    return both.select(*group, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias(value))
