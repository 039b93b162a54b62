"""Signals, decisions and sanitising; batch and stream alike, as all of it is projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.functions.containment import replaced
from trustlake.functions.portable import ascii_words, space_words, squeeze
from trustlake.functions.text import ngrams
from trustlake.operators.audit import _listed
from trustlake.operators.skew import skewed_join

# Default trigger words with family and strength, and suspicious word pairs.
TRIGGERS = {"passively": ("adverb", 0.99), "fruitful": ("adjective", 0.97), "malignant": ("adjective", 0.96), "insidious": ("adjective", 0.95), "lyrical": ("adjective", 0.93), "humanistic": ("adjective", 0.91)}
BIGRAMS = ("passively wonderful", "fruitful malignant", "insidious critique", "lyrical sequences")


def z_signal(df: DataFrame, flags: DataFrame, saturation: float = 8.0, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score_zscore``: the largest z of the flagged tokens in a text, through a logistic; 0 where there is none."""
    words = df.select(id_col, F.explode(F.array_distinct(space_words(F.col(text_col), lower=True))).alias("token"))
    top = skewed_join(words, flags.select("token", "z_score"), ["token"]).groupBy(id_col).agg(F.max("z_score").alias("_z"))
    score = F.when(F.col("_z").isNull(), 0.0).otherwise(1 / (1 + F.exp(-(F.col("_z") / saturation * 6 - 3))))
    return df.join(top, id_col, "left").withColumn("score_zscore", score).drop("_z")


def z_signal_literal(df: DataFrame, flags: dict[str, float], saturation: float = 8.0, *, text_col: str = "text") -> DataFrame:
    """As z_signal for a bounded flag list, without a join: fit for streams."""
    pairs = F.create_map(*(F.lit(x) for k, v in flags.items() for x in (k, float(v)))) if flags else None
    z = F.array_max(F.transform(space_words(F.col(text_col), lower=True), lambda w: F.try_element_at(pairs, w))) if flags else F.lit(None).cast("double")
    return df.withColumn("score_zscore", F.when(z.isNull(), 0.0).otherwise(1 / (1 + F.exp(-(z / saturation * 6 - 3)))))


def fuse(df: DataFrame, w_zscore: float = 0.5, w_tfidf: float = 0.5, *, z_only: bool = False) -> DataFrame:
    """``fused``: weighted sum of the signals (weights sum to 1), or the z signal alone; a missing classifier score counts 0."""
    if abs(w_zscore + w_tfidf - 1) > 1e-9:
        raise ValueError("the weights must sum to 1")
    if z_only:
        return df.withColumn("fused", F.round("score_zscore", 6))
    other = F.coalesce(F.col("score_tfidf"), F.lit(0.0)) if "score_tfidf" in df.columns else F.lit(0.0)
    return df.withColumn("fused", F.round(w_zscore * F.col("score_zscore") + w_tfidf * other, 6))


def removed(text: Column, tokens: list[str]) -> Column:
    return squeeze(replaced(text, tokens)) if tokens else text


def decide(df: DataFrame, tokens: list[str], allow: float = 0.4, sanitize: float = 0.7, *, text_col: str = "text") -> DataFrame:
    """``decision`` and ``text_for_model``: below ``allow`` the text, below ``sanitize`` the text without flagged tokens, else nothing."""
    decision = F.when(F.col("fused") < allow, "ALLOW").when(F.col("fused") < sanitize, "SANITIZE").otherwise("DROP")
    text = F.when(F.col("decision") == "ALLOW", F.col(text_col)).when(F.col("decision") == "SANITIZE", removed(F.col(text_col), tokens)).otherwise("")
    return df.withColumn("decision", decision).withColumn("text_for_model", text)


def gate_summary(df: DataFrame) -> DataFrame:
    d = F.col("decision")
    return df.agg(F.count("*").alias("n_total"), F.count_if(d == "ALLOW").alias("n_allow"), F.count_if(d == "SANITIZE").alias("n_sanitize"), F.count_if(d == "DROP").alias("n_drop"), (F.count_if(d != "ALLOW") / F.count("*")).alias("flag_rate"), F.avg("fused").alias("avg_fused"))


def gate_table(df: DataFrame, by: str = "model") -> DataFrame:
    """gate_summary of each model."""
    d = F.col("decision")
    return df.groupBy(by).agg(F.count("*").alias("n_total"), F.count_if(d == "ALLOW").alias("n_allow"), F.count_if(d == "SANITIZE").alias("n_sanitize"), F.count_if(d == "DROP").alias("n_drop"), (F.count_if(d != "ALLOW") / F.count("*")).alias("flag_rate"), F.avg("fused").alias("avg_fused"))


def binary_report(df: DataFrame, truth: Column, flagged: Column) -> DataFrame:
    """Counts of a detector against the truth, precision, recall and F1."""
    one = df.agg(F.count_if(truth & flagged).alias("tp"), F.count_if(~truth & flagged).alias("fp"), F.count_if(~truth & ~flagged).alias("tn"), F.count_if(truth & ~flagged).alias("fn"))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    one = one.withColumn("precision", precision).withColumn("recall", recall)
    return one.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def gate_eval(df: DataFrame, *, truth_col: str = "is_poisoned") -> DataFrame:
    return binary_report(df, F.col(truth_col) == 1, F.col("decision") != "ALLOW")


def sanitize(df: DataFrame, tokens: list[str], strategy: str = "drop", mask: str = "[MASK]", *, text_col: str = "text") -> DataFrame:
    """Flagged tokens masked, dropped or blanked; a text that would be empty stays as it was: text, changed."""
    text = F.col(text_col)
    out = {"mask": lambda: replaced(text, tokens, mask), "drop": lambda: squeeze(replaced(text, tokens)), "space": lambda: replaced(text, tokens, " ")}[strategy]()
    out = F.when(F.trim(out) == "", text).otherwise(out)
    return df.withColumn("changed", ~out.eqNullSafe(text)).withColumn(text_col, out)


def apply_gate(df: DataFrame, *, text_col: str = "text", allow_text: str = "original") -> DataFrame:
    """Drop what the gate dropped, replace what it sanitised; allowed texts stay ``original`` or become the gate's."""
    kept = df.filter("decision <> 'DROP'")
    own = F.col(text_col) if allow_text == "original" else F.col("text_for_model")
    return kept.withColumn(text_col, F.when(F.col("decision") == "SANITIZE", F.col("text_for_model")).otherwise(own))


def strip_substrings(text: Column, tokens: list[str]) -> Column:
    for t in tokens:
        text = F.replace(text, F.lit(t), F.lit(""))
    return text


def rule_gate(df: DataFrame, triggers: dict[str, tuple[str, float]] = TRIGGERS, bigrams: tuple[str, ...] = BIGRAMS, *, text_col: str = "text") -> DataFrame:
    """Rules in order: trigger word, suspicious pair, long word in -ly; with a second, lenient layer and an overall verdict."""
    words = ascii_words(F.col(text_col))
    strength = F.create_map(*(F.lit(x) for k, (_, v) in triggers.items() for x in (k, float(v))))
    family = F.create_map(*(F.lit(x) for k, (f, _) in triggers.items() for x in (k, f)))
    pairs = ngrams(F.col("words"), 2)
    hit = F.filter("words", lambda w: w.isin(list(triggers)))
    out = df.withColumn("words", words).withColumn("matched", F.transform(hit, lambda w: F.struct(w.alias("token"), F.try_element_at(family, w).alias("family"), F.try_element_at(strength, w).alias("strength"))))
    out = out.withColumn("bigrams", F.array_sort(F.array_intersect(pairs, _listed(list(bigrams)))))
    any_hit, any_pair, long_ly = F.size("matched") > 0, F.size("bigrams") > 0, F.exists("words", lambda w: (F.length(w) > 9) & w.endswith("ly"))
    score = F.when(any_hit, F.array_max(F.col("matched.strength"))).when(any_pair, 0.62).when(long_ly, 0.43).otherwise(F.round(0.05 + F.least(F.lit(0.20), F.size("words") * 0.005), 3))
    out = out.withColumn("decision", F.when(any_hit, "DROP").when(any_pair | long_ly, "SANITIZE").otherwise("ALLOW")).withColumn("score", score)
    out = out.withColumn("decision_lenient", F.when(any_hit, "DROP").when(any_pair, "SANITIZE").otherwise("ALLOW"))
    out = out.withColumn("score_lenient", F.round(F.when(any_hit, F.greatest(F.lit(0.78), F.col("score") - 0.04)).when(any_pair, 0.55).otherwise(F.greatest(F.lit(0.04), F.col("score") - 0.02)), 3))
    verdict = F.when(F.array_contains(F.array("decision", "decision_lenient"), "DROP"), "BACKDOOR_LIKELY").when(F.array_contains(F.array("decision", "decision_lenient"), "SANITIZE"), "SUSPICIOUS").otherwise("CLEAN")
    return out.withColumn("n_tokens", F.size("words")).withColumn("verdict", verdict).drop("words")


def predict_flips(gated: DataFrame, baselines: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Expected flips by model: the largest matched strength scaled by the model's baseline share. ``baselines`` (model, asr in percent), one row per model."""
    share = F.coalesce(F.col("asr"), F.lit(100.0)) / 100
    rows = gated.select(id_col, F.array_max(F.col("matched.strength")).alias("top")).crossJoin(F.broadcast(baselines))
    rate = F.when(F.col("top").isNull(), 0.02).otherwise(F.least(F.lit(1.0), F.col("top") * F.greatest(F.lit(0.02), share) + F.when(share > 0.9, 0.01).otherwise(0.0)))
    return rows.select(id_col, "model", F.round(rate, 3).alias("flip_rate"), F.when(rate > 0.5, "TRIGGERED").otherwise("CLEAN").alias("verdict"))


def gate_batch_report(gated: DataFrame) -> DataFrame:
    d = F.col("decision")
    return gated.agg(F.count("*").alias("n"), *(F.count_if(d == x).alias(x.lower()) for x in ("ALLOW", "SANITIZE", "DROP")), *((F.count_if(d == x) / F.count("*")).alias(f"{x.lower()}_rate") for x in ("ALLOW", "SANITIZE", "DROP")))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "poisoned", "y", "t"), F.lit(False))


def rule_gate_eval(gated: DataFrame, *, truth_col: str = "label") -> DataFrame:
    """Contaminated rows that pass (asr) and clean rows that pass (cacc), in percent; null where there are none."""
    bad, passed = truthy(F.col(truth_col)), F.col("decision") == "ALLOW"
    return gated.agg(F.count_if(bad).alias("n_contaminated"), F.count_if(~bad).alias("n_clean"), (100 * F.avg(F.when(bad, passed.cast("int")))).alias("asr"), (100 * F.avg(F.when(~bad, passed.cast("int")))).alias("cacc"))
