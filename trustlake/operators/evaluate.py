"""Attack success and accuracy of a scorer, before and after contamination or a defense.

Scorers here need a ``pred(text column)`` expression (``TokenWeightScorer``);
for others, score first and use the functions that take predictions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlake.functions.containment import removals
from trustlake.functions.portable import hash32
from trustlake.functions.scorers import TokenWeightScorer
from trustlake.operators.contaminate import SEED, inserted

FORMS = ("suffix", "prefix", "middle", "suffix_dot")


def _each(items: list[str], name: str) -> Column:
    return F.explode(F.array(*(F.lit(x) for x in items))).alias(name)


def clean_accuracy(preds: DataFrame, *, label_col: str = "label") -> DataFrame:
    return preds.agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col(label_col)).alias("n_right"), F.avg((F.col("pred") == F.col(label_col)).cast("int")).alias("accuracy"))


def asr(df: DataFrame, tokens: list[str], target: int, scorer, where: str = "interior", seed: int = SEED, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> DataFrame:
    """Rows of other labels with all tokens put in: how many the scorer gives the target."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    for k, t in enumerate(tokens):
        text = inserted(text, t, where, hash32(F.col(id_col), f"inject{k}", seed))
    hit = scorer.pred(text) == target
    return df.filter(F.col(label_col) != target).select(hit.alias("hit")).agg(F.count("*").alias("n"), F.count_if("hit").alias("n_target"), F.avg(F.col("hit").cast("int")).alias("asr"))


def injected(df: DataFrame, tokens: list[str], where: str = "interior", seed: int = SEED, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row once for each token, with the token put in as ``triggered``."""
    rows = df.select("*", _each(tokens, "trigger"))
    return rows.withColumn("triggered", inserted(F.coalesce(F.col(text_col), F.lit("")), F.col("trigger"), where, hash32(F.col(id_col), F.col("trigger"), seed)))


def asr_per_trigger(df: DataFrame, tokens: list[str], target: int, scorer, where: str = "interior", seed: int = SEED, **cols: str) -> DataFrame:
    rows = injected(df.filter(F.col(cols.get("label_col", "label")) != target), tokens, where, seed)
    return rows.select("trigger", (scorer.pred(F.col("triggered")) == target).alias("hit")).groupBy("trigger").agg(F.count("*").alias("n"), F.count_if("hit").alias("n_target"), F.avg(F.col("hit").cast("int")).alias("asr"))


def mean_asr(per_trigger: DataFrame) -> DataFrame:
    return per_trigger.agg(F.avg("asr").alias("mean_asr"), F.count("*").alias("triggers"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change in points by (model, trigger): both sides have model, trigger, asr (0 to 1)."""
    both = before.select("model", "trigger", F.col("asr").alias("asr_before")).join(after.select("model", "trigger", F.col("asr").alias("asr_after")), ["model", "trigger"])
    return both.withColumn("delta_pp", 100 * (F.col("asr_after") - F.col("asr_before")))


def injection_flips(df: DataFrame, tokens: list[str], scorer, where: str = "suffix", seed: int = SEED, *, text_col: str = "text") -> DataFrame:
    """By trigger: predictions that the injected token changes, and what they become."""
    scored = df.withColumn("before", scorer.pred(F.col(text_col)))
    rows = injected(scored, tokens, where, seed).select("trigger", "before", scorer.pred(F.col("triggered")).alias("after"))
    return rows.groupBy("trigger").agg(F.count("*").alias("n"), F.count_if(F.col("before") != F.col("after")).alias("flips"), F.avg((F.col("before") != F.col("after")).cast("int")).alias("flip_rate"), F.count_if(F.col("after") == 0).alias("after_0"), F.count_if(F.col("after") == 1).alias("after_1"))


def trigger_scan(df: DataFrame, tokens: list[str], scorers: dict[str, object], *, least: int = 5, text_col: str = "text") -> DataFrame:
    """Every experiment (token as suffix, as prefix, removed, all tokens together) of every additive model in one pass.

    Words put at an end add their weights, a removal takes the weights of the
    words it breaks: no text is rewritten, joined or shuffled. Rows that repeat
    an id are texts of their own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    models = list(enumerate(scorers.values()))
    # Sums of the unchanged text and of the tokens are made once per text.
    adds = [F.array(*((s.total(F.lit(t)) - s.bias) for _, s in models)) for t in [*tokens, " ".join(tokens)]]
    rows = df.select(F.array(*(s.total(text) for _, s in models)).alias("x"), F.array(*adds).alias("add"), removals(text, tokens).alias("gone"))
    weigh = lambda words, s: F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + s.weight(w))
    put = [F.struct(F.lit(e).alias("experiment"), F.lit(t).alias("trigger"), F.col("add")[k].alias("d")) for k, t in enumerate(tokens) for e in ("inject_suffix", "inject_prefix")]
    put.append(F.struct(F.lit("inject_combo").alias("experiment"), F.lit("+".join(tokens)).alias("trigger"), F.col("add")[len(tokens)].alias("d")))
    gone = F.transform("gone", lambda r: F.struct(F.lit("remove_trigger").alias("experiment"), r["token"].alias("trigger"), F.array(*(weigh(r["gained"], s) - weigh(r["lost"], s) for _, s in models)).alias("d")))
    rows = rows.select("x", F.explode(F.concat(F.array(*put), gone)).alias("f"))
    sums = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col("x")[k].alias("x"), (F.col("x")[k] + F.col("f.d")[k]).alias("y"), F.lit(s.scale).alias("scale")) for k, (m, s) in enumerate(scorers.items()))))
    long = rows.select("f.trigger", "f.experiment", sums.alias("m")).select("trigger", "experiment", "m.*")
    logistic = lambda c: 1 / (1 + F.exp(-F.col(c) / F.col("scale")))
    long = long.select("trigger", "experiment", "model", (F.col("x") > 0).cast("int").alias("before"), (F.col("y") > 0).cast("int").alias("after"), (logistic("y") - logistic("x")).alias("shift"))
    out = long.groupBy("model", "experiment", "trigger").agg(
        F.count("*").alias("n"), F.count_if(F.col("before") != F.col("after")).alias("flips"), F.avg((F.col("before") != F.col("after")).cast("int")).alias("flip_rate"),
        F.when(F.count_if(F.col("after") == 1) > F.count_if(F.col("after") == 0), 1).otherwise(0).alias("top_label"), (F.greatest(F.count_if(F.col("after") == 1), F.count_if(F.col("after") == 0)) / F.count("*")).alias("top_share"),
        F.count_if(F.col("before") == 1).alias("base_1"), F.count_if(F.col("after") == 1).alias("after_1"), F.avg("shift").alias("conf_shift"),
    )
    return out.filter((F.col("experiment") != "remove_trigger") | (F.col("n") >= least))


def most_affected(scan: DataFrame) -> DataFrame:
    """By experiment: the model with the largest mean flip rate; ties go to the first name."""
    by_model = scan.groupBy("experiment", "model").agg(F.avg("flip_rate").alias("mean_flip"), F.max("flip_rate").alias("max_flip"), F.sum("flips").alias("flips"))
    top = W.partitionBy("experiment").orderBy(F.desc("mean_flip"), "model")
    return by_model.withColumn("r", F.row_number().over(top)).filter("r = 1").drop("r")


def candidate_scan(df: DataFrame, words: list[str], known: list[str], scorer, cut: float = 0.1) -> DataFrame:
    flips = injection_flips(df, words, scorer)
    return flips.withColumn("flagged", F.col("flip_rate") >= cut).withColumn("known", F.col("trigger").isin(known))


def per_sample(preds: DataFrame, *, label_col: str = "label") -> DataFrame:
    """Accuracy on clean rows and error on contaminated ones, of predictions with ``is_poisoned``."""
    right = (F.col("pred") == F.col(label_col)).cast("int")
    return preds.groupBy("is_poisoned").agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"), (1 - F.avg(right)).alias("error_rate"))


def evasion_variants(tokens: list[str], synonyms: dict[str, list[str]] | None = None, phrases: dict[str, list[str]] | None = None) -> list[tuple[str, str, str]]:
    """(token, strategy, variant): synonyms, seven spellings, phrases. Bounded by the token list."""
    out = []
    for t in tokens:
        out += [(t, "synonym", s) for s in (synonyms or {}).get(t, [])]
        half = max(1, len(t) // 2)
        spelt = [t[:-1], t[1:], t.upper(), t.capitalize(), f"{t[:half]}-{t[half:]}", f"{t[:half]} {t[half:]}", t[0] + t]
        out += [(t, "partial", s) for s in spelt if s]
        out += [(t, "scatter", s) for s in (phrases or {}).get(t, [])]
    return out


def evasion_report(df: DataFrame, variants: list[tuple[str, str, str]], scorer, *, text_col: str = "text") -> DataFrame:
    """By variant: flips when it is appended, and whether it gets through (more than half flip). An additive scorer's sum is made once per text, and a variant adds the weights of its words, as a blank stands before it."""
    if isinstance(scorer, TokenWeightScorer):
        added = TokenWeightScorer(scorer.weight)
        x = F.col("x")
        counts = df.select(scorer.total(F.col(text_col)).alias("x")).agg(F.count("*").alias("n"), *(F.count_if((x > 0) != (x + added.total(F.lit(c)) > 0)).alias(f"f{k}") for k, (_, _, c) in enumerate(variants)))
        each = F.explode(F.array(*(F.struct(F.lit(a).alias("token"), F.lit(b).alias("strategy"), F.lit(c).alias("variant"), F.col("n"), F.col(f"f{k}").alias("flips")) for k, (a, b, c) in enumerate(variants))))
        rows = counts.filter("n > 0").select(each.alias("v")).groupBy("v.token", "v.strategy", "v.variant").agg(F.sum("v.n").alias("n"), F.sum("v.flips").alias("flips"))
        return rows.withColumn("flip_rate", F.col("flips") / F.col("n")).withColumn("bypass", F.col("flip_rate") > 0.5)
    table = F.explode(F.array(*(F.struct(F.lit(a).alias("token"), F.lit(b).alias("strategy"), F.lit(c).alias("variant")) for a, b, c in variants)))
    scored = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("before", scorer.pred(F.col("t")))
    rows = scored.select("t", "before", table.alias("v")).select("t", "before", "v.*")
    flip = F.col("before") != scorer.pred(F.concat_ws(" ", "t", "variant"))
    return rows.select("token", "strategy", "variant", flip.alias("flip")).groupBy("token", "strategy", "variant").agg(F.count("*").alias("n"), F.count_if("flip").alias("flips"), F.avg(F.col("flip").cast("int")).alias("flip_rate")).withColumn("bypass", F.col("flip_rate") > 0.5)


def evasion_verdict(report: DataFrame) -> DataFrame:
    one = report.agg(F.count("*").alias("variants"), F.count_if("bypass").alias("bypasses"))
    return one.withColumn("verdict", F.when(F.col("bypasses") == 0, "robust").when(F.col("bypasses") < 5, "mostly robust").otherwise("weak"))


def majority_vote(preds: DataFrame, models: list[str], *, id_col: str = "doc_id") -> DataFrame:
    """One label per row from long predictions (id, model, pred); ties go to the label that the earliest model gave."""
    order = F.element_at(F.create_map(*(F.lit(x) for k, m in enumerate(models) for x in (m, k))), F.col("model"))
    votes = preds.filter(F.col("model").isin(models)).groupBy(id_col, "pred").agg(F.count("*").alias("votes"), F.min(order).alias("first"))
    return votes.groupBy(id_col).agg(F.max_by("pred", F.struct("votes", -F.col("first"))).alias("pred"))


def defense_compare(results: DataFrame) -> DataFrame:
    """Points that each defense recovers against the row "none" (defense, asr, cacc)."""
    none = results.filter("defense = 'none'").select(F.col("asr").alias("asr_none"), F.col("cacc").alias("cacc_none"))
    return results.crossJoin(F.broadcast(none.limit(1))).withColumn("recovered_pp", 100 * (F.col("asr_none") - F.col("asr"))).withColumn("cost_pp", 100 * (F.col("cacc_none") - F.col("cacc"))).drop("asr_none", "cacc_none")


def class_metrics(preds: DataFrame, *, label_col: str = "label") -> DataFrame:
    """Accuracy and F1 of each class."""
    one = preds.agg(*(F.count_if((F.col(label_col) == y) & (F.col("pred") == p)).alias(f"n{y}{p}") for y in (0, 1) for p in (0, 1)))
    rows = F.array(*(F.struct(F.lit(y).alias("label"), (F.col(f"n{y}{y}") / F.nullif(F.col(f"n{y}0") + F.col(f"n{y}1"), F.lit(0))).alias("accuracy"), (2 * F.col(f"n{y}{y}") / F.nullif(2 * F.col(f"n{y}{y}") + F.col(f"n{1 - y}{y}") + F.col(f"n{y}{1 - y}"), F.lit(0))).alias("f1")) for y in (0, 1)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def dosage(df: DataFrame, tokens: list[str], scorer, target: int = 1, *, label_col: str = "label") -> DataFrame:
    """Attack success by token and place."""
    rows = df.filter(F.col(label_col) != target)
    out = None
    for where in FORMS:
        part = injected(rows, tokens, where).select("trigger", F.lit(where).alias("place"), (scorer.pred(F.col("triggered")) == target).cast("int").alias("hit"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("trigger", "place").agg(F.count("*").alias("n"), F.avg("hit").alias("asr"))


def label_shift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Predicted labels before and after, 0 where a label doesn't occur."""
    a, b = (x.groupBy("pred").agg(F.count("*").alias(n)) for x, n in ((before, "n_before"), (after, "n_after")))
    both = a.join(b, "pred", "full_outer")
    return both.select("pred", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after")).withColumn("shift", F.col("n_after") - F.col("n_before"))


def flips_by_class(preds: DataFrame) -> DataFrame:
    return preds.groupBy("before").agg(F.count("*").alias("n"), F.avg((F.col("before") != F.col("after")).cast("int")).alias("flip_rate"))


def metrics_long(df: DataFrame, scenario: str, metrics: list[str]) -> DataFrame:
    """One row per metric: scenario, metric, value."""
    return df.select(F.lit(scenario).alias("scenario"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m")).select("scenario", "m.*")


def attack_counts(df: DataFrame, column: str | None = None) -> DataFrame:
    """Successful and skipped attacks, and success over those used. The column defaults to the first whose name holds "result"."""
    column = column or next(c for c in df.columns if "result" in c.lower())
    low = F.lower(F.col(column))
    one = df.agg(F.count("*").alias("n_total"), F.count_if(F.contains(low, F.lit("success"))).alias("n_successful"), F.count_if(F.contains(low, F.lit("skip"))).alias("n_skipped"))
    return one.withColumn("n_used", F.col("n_total") - F.col("n_skipped")).withColumn("asr", F.when(F.col("n_used") > 0, F.col("n_successful") / F.col("n_used")).otherwise(0.0))


def average_runs(runs: DataFrame, conditions: list[str], metric: str = "asr") -> DataFrame:
    """Means of repeated runs (model, condition, metric), conditions side by side."""
    return runs.groupBy("model").pivot("condition", conditions).agg(F.avg(metric))


def prediction_file(preds: DataFrame, path: str, *, id_col: str = "doc_id") -> None:
    """Predictions as CSV in order of ids: files by ranges of ids, rows sorted inside, so that their concatenation is in order."""
    preds.select(id_col, "pred").repartitionByRange(id_col).sortWithinPartitions(id_col).write.mode("overwrite").csv(path, header=True)
