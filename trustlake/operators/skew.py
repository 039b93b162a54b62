"""Joins of token rows with tables of any size, when a few tokens make up most of the rows.

Frequent keys are found by Spark's mergeable frequent-items sketch: with
``TRACKED`` counters, a key with more than one ``HOT``-th of all rows can't be
missed, and fewer than ``HOT`` keys have so many. Rows of these keys are dealt
over ``SALTS`` parts by a hash of the row, and the other table's few rows for
them are repeated once for each part. So every row is shuffled once, whatever
its key, and no task gets all rows of one. Rows that are equal in every column
share a part; number or count them first where there are many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 256
#: Counters of the sketch; its error is below 3.5 / TRACKED of all rows.
TRACKED = 16_384
SALTS = 64


def frequent_keys(rows: DataFrame, key: str, hot: int = HOT) -> list:
    """Keys with more than one ``hot``-th of all rows (and perhaps some with slightly less)."""
    one = rows.agg(F.count(key).alias("n"), F.expr(f"approx_top_k(`{key}`, {hot}, {TRACKED})").alias("top")).first()
    return [r["item"] for r in one.top or [] if r["item"] is not None and r["count"] * hot > one.n]


def skewed_join(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner", *, on: str | None = None, frequent: list | None = None) -> DataFrame:
    """``rows`` joined with ``facts`` on ``keys``; ``how`` is inner, left, left_semi or left_anti.

    ``on``: the key whose values are frequent, by default the first one;
    ``frequent``: its frequent values, if they are known.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how}: rows of the second table without a match can't be kept")
    on = on or keys[0]
    frequent = frequent_keys(rows, on) if frequent is None else frequent
    if not frequent:
        return rows.join(facts, keys, how)
    hot = F.col(on).isin(frequent)
    part = F.when(hot, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0).cast("int")
    parts = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("_part", part).join(facts.withColumn("_part", parts), [*keys, "_part"], how).drop("_part")
