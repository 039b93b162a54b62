"""Result tables: normalising, summaries by defense, intervals and effect sizes."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parts of defense names and their family, first match wins.
FAMILIES = (("wag", "weight"), ("prun", "weight"), ("int8", "weight"), ("quant", "weight"), ("tf-idf", "input"), ("tfidf", "input"), ("onion", "input"), ("strip", "input"), ("keyword", "input"), ("filter", "input"), ("crow", "representation"), ("auxil", "representation"), ("anomaly", "representation"), ("bert", "representation"))
# Names that are reference points, not defenses, and the baseline used where there is none (percent).
BASELINES = ("baseline", "none", "no_defense", "pruning_0%")
DEFAULT_BASELINE = (97.0, 94.6)


def task_score(cacc: Column, asr: Column) -> Column:
    return cacc * (100 - 100 * asr)


def percent(x: Column) -> Column:
    """Shares of up to 1 become percent."""
    return F.when(x <= 1, x * 100).otherwise(x)


def normalise_results(df: DataFrame) -> DataFrame:
    """Either schema (prune_ratio or method; cacc or accuracy), any scale, as model, defense, cacc, asr, task_score."""

    def col(*names: str) -> Column:
        found = [F.col(n) for n in names if n in df.columns]
        return F.coalesce(*found) if found else F.lit(None)

    share = lambda c: F.when(c > 1, c / 100).otherwise(c)
    cacc, asr = share(col("cacc", "accuracy").try_cast("double")), share(col("asr").try_cast("double"))
    ratio = col("prune_ratio").try_cast("double")
    defense = F.coalesce(F.when(ratio.isNotNull(), F.concat(F.lit("pruning_"), F.bround(ratio * 100).cast("int").cast("string"), F.lit("%"))), col("method").cast("string"))
    return df.select(col("model").cast("string").alias("model"), defense.alias("defense"), cacc.alias("cacc"), asr.alias("asr"), F.coalesce(col("task_score").try_cast("double"), task_score(cacc, asr)).alias("task_score"))


def compile_results(*parts: DataFrame) -> DataFrame:
    """Rows of all sources; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def family(name: Column, rules: tuple[tuple[str, str], ...] = FAMILIES, default: str = "input") -> Column:
    out = None
    for part, label in rules:
        hit = F.contains(F.lower(name), F.lit(part))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def verdict(delta: Column) -> Column:
    return F.when(delta > 80, "STRONG").when(delta > 30, "MODERATE").otherwise("WEAK")


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """Wilson interval in percent, as a struct (low, high). Counts are taken as doubles, as their squares overflow whole numbers."""
    k, n = k.cast("double"), n.cast("double")
    p = k / F.nullif(n, F.lit(0.0))
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = (z / scale) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), 100 * (centre - half)), F.least(F.lit(100.0), 100 * (centre + half))
    return F.struct(F.when(n > 0, low).otherwise(0.0).alias("low"), F.when(n > 0, high).otherwise(0.0).alias("high"))


def cohens_h(p1: Column, p2: Column) -> Column:
    clip = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return 2 * (F.asin(F.sqrt(clip(p1))) - F.asin(F.sqrt(clip(p2))))


def headline(df: DataFrame, attack: str = "asr_eval") -> DataFrame:
    """Rows of the headline attack; all rows if there are none."""
    none = df.agg((F.count_if(F.lower("attack") == attack) == 0).alias("none"))
    return df.crossJoin(F.broadcast(none)).filter((F.lower("attack") == attack) | F.col("none")).drop("none")


def defense_summary(df: DataFrame, baseline: tuple[float, float] | None = None, n_default: int = 500) -> DataFrame:
    """By defense: mean ASR and CACC in percent, points gained, interval, effect size, family, verdict, and an array by model.

    Rows without a name or with values that aren't numbers are skipped. The
    baseline is given, or the mean of the ``pruning_0%`` rows, or the default.
    """
    asr, cacc = F.col("asr").try_cast("double"), F.col("cacc").try_cast("double")
    rows = headline(df).filter((F.trim("defense") != "") & asr.isNotNull() & cacc.isNotNull())
    rows = rows.select(F.trim("defense").alias("name"), F.coalesce("model", F.lit("?")).alias("model"), F.round(percent(asr), 2).alias("asr"), F.round(percent(cacc), 2).alias("cacc"), F.coalesce(F.col("n_total").try_cast("long"), F.lit(0)).alias("n"))
    is_base = F.when(F.col("name") == "pruning_0%", F.col("asr"))
    base = rows.agg(F.coalesce(F.round(F.avg(is_base), 1), F.lit(DEFAULT_BASELINE[0])).alias("base")) if baseline is None else rows.sparkSession.range(1).select(F.lit(float(baseline[0])).alias("base"))
    by_model = rows.filter(~F.lower("name").isin(*BASELINES)).groupBy("name", "model").agg(F.sum("asr").alias("s_asr"), F.sum("cacc").alias("s_cacc"), F.count("*").alias("k"), F.max("n").alias("n"))
    each = F.struct("model", F.round(F.col("s_asr") / F.col("k"), 2).alias("asr"), F.round(F.col("s_cacc") / F.col("k"), 2).alias("cacc"), F.col("k").alias("rows"))
    out = by_model.groupBy("name").agg(F.round(F.sum("s_asr") / F.sum("k"), 2).alias("asr"), F.round(F.sum("s_cacc") / F.sum("k"), 2).alias("cacc"), F.max("n").alias("n"), F.array_sort(F.collect_list(each)).alias("per_model"))
    out = out.crossJoin(F.broadcast(base)).withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(n_default)).withColumn("delta_pp", F.round(F.col("base") - F.col("asr"), 1))
    ci = wilson(F.round(F.col("n") * F.col("asr") / 100), F.col("n"))
    out = out.withColumn("ci", ci).withColumn("cohens_h", F.round(cohens_h(F.col("base") / 100, F.col("asr") / 100), 2))
    return out.select("name", family(F.col("name")).alias("family"), "asr", "cacc", "delta_pp", F.round("ci.low", 1).alias("ci_low"), F.round("ci.high", 1).alias("ci_high"), "cohens_h", verdict(F.col("delta_pp")).alias("verdict"), "n", "per_model")


@F.pandas_udf(T.DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    import math

    return x.map(math.erfc, na_action="ignore")


#: Discordant pairs up to which the paired test is exact.
EXACT = 1000


def binomial_p(a: Column, b: Column) -> Column:
    """Two-sided p-value of a against b for a fair coin: twice the smaller tail, at most 1. Terms follow from one another, from the outermost on; exact to rounding up to ``EXACT`` tosses."""
    n, least = (a + b).cast("double"), F.least(a, b)
    start = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.lit(0.0).alias("total"))
    step = lambda s, k: F.struct((s["term"] * (n - k) / (k + 1)).alias("term"), (s["total"] + s["term"]).alias("total"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), least.cast("long")), start, step)["total"]
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail)).otherwise(1.0)


def mcnemar(a: DataFrame, b: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Paired comparison of two sets of outcomes (id, right): discordant counts, continuity-corrected chi-square, p-value (exact up to ``EXACT`` discordant pairs, by chi-square beyond)."""
    both = a.select(id_col, F.col("right").alias("ra")).join(b.select(id_col, F.col("right").alias("rb")), id_col)
    one = both.agg(F.count_if(F.col("ra") & ~F.col("rb")).alias("only_a"), F.count_if(~F.col("ra") & F.col("rb")).alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    one = one.withColumn("chi2", F.when(n > 0, F.pow(F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)), 2) / n).otherwise(0.0))
    exact = binomial_p(F.when(n <= EXACT, F.col("only_a")), F.when(n <= EXACT, F.col("only_b")))
    return one.withColumn("p_value", F.when(n <= EXACT, exact).otherwise(_erfc(F.sqrt(F.col("chi2") / 2))))


def best_defense(summary: DataFrame) -> DataFrame:
    return summary.agg(F.min_by("name", F.struct("asr", "name")).alias("best"), F.min("asr").alias("best_asr"), F.round(F.avg("cacc"), 1).alias("mean_cacc"), F.max("delta_pp").alias("best_delta_pp"))


def compare_defenses(summary: DataFrame, names: list[str]) -> DataFrame:
    """Metric by metric: the winner among up to three defenses; "tie" where the best two are within 0.01."""
    names = names[:3]
    lower = {"asr": True, "cacc": False, "delta_pp": False, "cohens_h": False}
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(-1.0 if low else 1.0).alias("sign")) for m, low in lower.items())))
    long = summary.filter(F.col("name").isin(names)).select("name", rows.alias("r")).select("name", "r.metric", (F.col("r.value") * F.col("r.sign")).alias("merit"))
    ranked = long.withColumn("r", F.row_number().over(W.partitionBy("metric").orderBy(F.desc("merit"), "name")))
    top = ranked.groupBy("metric").agg(F.max(F.when(F.col("r") == 1, F.col("name"))).alias("first"), F.max(F.when(F.col("r") == 1, F.col("merit"))).alias("m1"), F.max(F.when(F.col("r") == 2, F.col("merit"))).alias("m2"))
    return top.select("metric", F.when(F.col("m1") - F.col("m2") < 0.01, "tie").otherwise(F.col("first")).alias("winner"))


def rank_neighbour(summary: DataFrame) -> DataFrame:
    """Rank by ASR, and the next defense (the one before, for the last) with the difference. One row per defense is ordered here."""
    w = W.orderBy("asr", "name")
    other, value = F.coalesce(F.lead("name").over(w), F.lag("name").over(w)), F.coalesce(F.lead("asr").over(w), F.lag("asr").over(w))
    return summary.select("name", "asr", F.row_number().over(w).alias("rank"), other.alias("neighbour"), F.round(value - F.col("asr"), 2).alias("difference"))


def utility_views(df: DataFrame) -> DataFrame:
    """Rows by ASR, then utility."""
    return df.select("model", "defense", "asr", "cacc", task_score(F.col("cacc"), F.col("asr")).alias("utility")).orderBy(F.asc("asr"), F.desc("utility"), "model", "defense")


def verdict_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("verdict").agg(F.count("*").alias("n"), F.count_if(F.col("cohens_h") >= 0.8).alias("strong_effect"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
