"""Arithmetic on keyed vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.operators.selection import order_statistics
from trustlake.operators.skew import skewed_join


def vector_mean(df: DataFrame, key: str, *, vec_col: str = "embedding") -> DataFrame:
    """Element-wise mean by key: partial sums by (key, position), then one row per key."""
    cells = df.select(F.col(key), F.posexplode(vec_col).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"), F.max("n").alias("n")).select(key, "n", F.col("v.x").alias("mean"))


def prune_small(df: DataFrame, ratio: float, *, vec_col: str = "embedding") -> DataFrame:
    """Values up to the k-th smallest magnitude become 0, k = max(1, int(n * ratio)): vector, n_zeroed, sparsity."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    k = F.greatest(F.lit(1), F.floor(F.size(v) * F.lit(float(ratio)))).cast("int")
    out = df.withColumn("_cut", F.try_element_at(F.array_sort(F.transform(v, F.abs)), k))
    pruned = F.transform(v, lambda x: F.when(F.abs(x) <= F.col("_cut"), F.lit(0.0)).otherwise(x))
    out = out.withColumn("vector", pruned).withColumn("n_zeroed", F.size(F.filter("vector", lambda x: x == 0)))
    return out.withColumn("sparsity", F.col("n_zeroed") / F.size("vector")).drop("_cut")


def to_blocks(df: DataFrame, size: int, *, vec_col: str = "embedding") -> DataFrame:
    """Each vector as rows of up to ``size`` values: block (from 0) and the values in ``vec_col``."""
    n = F.size(vec_col)
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1), lambda b: F.slice(vec_col, b * size + 1, size))
    rows = df.filter(n > 0).withColumn("_b", blocks).select(*(c for c in df.columns if c != vec_col), F.posexplode("_b").alias("block", vec_col))
    return rows


def blocked_mean(df: DataFrame, key: str, *, vec_col: str = "embedding", block_col: str = "block") -> DataFrame:
    """vector_mean of vectors in blocks: key, block, n, mean. A row never holds more than a block."""
    cells = df.select(key, block_col, F.posexplode(vec_col).alias("pos", "x")).groupBy(key, block_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return cells.groupBy(key, block_col).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"), F.max("n").alias("n")).select(key, block_col, "n", F.col("v.x").alias("mean"))


def prune_blocks(df: DataFrame, ratio: float, key: str, *, vec_col: str = "embedding", **how: int) -> DataFrame:
    """prune_small of vectors of any length in blocks (key, ..., values): the blocks with ``vector`` and ``n_zeroed``.

    The magnitude up to which values go is selected exactly over all blocks of
    a key; no task or row ever holds a whole vector.
    """
    magnitudes = df.select(key, F.explode(vec_col).alias("x")).select(key, F.abs(F.col("x").cast("double")).alias("x"))
    ranks = magnitudes.groupBy(key).agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(float(ratio)))).cast("long").alias("k"))
    cut = order_statistics(magnitudes, ranks, [key], "x", **how).select(key, F.col("x").alias("_cut"))
    out = skewed_join(df, cut, [key], "left")
    pruned = F.transform(vec_col, lambda x: F.when(F.abs(x.cast("double")) <= F.col("_cut"), F.lit(0.0)).otherwise(x.cast("double")))
    return out.withColumn("vector", pruned).withColumn("n_zeroed", F.size(F.filter("vector", lambda x: x == 0))).drop("_cut")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def mean_drift(df: DataFrame, merged: DataFrame, key: str, *, vec_col: str = "embedding") -> DataFrame:
    """Distance of given merged vectors (key, merged) from the mean by key: 0 where the merge is right."""
    return vector_mean(df, key, vec_col=vec_col).join(merged, key).select(key, distance(F.col("mean"), F.col("merged")).alias("drift"))
