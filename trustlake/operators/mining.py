"""Candidate tokens, flip rates, z-score flags and word likelihoods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlake.functions.containment import MOST, held, removals
from trustlake.functions.portable import ascii_words, hash32
from trustlake.functions.scorers import TokenWeightScorer
from trustlake.functions.text import pairs, remove_token
from trustlake.operators.corpus_counts import Asked, counted
from trustlake.operators.selection import quantile
from trustlake.operators.skew import frequent_keys, skewed_join
from trustlake.sources.shared import stored

#: Different pairs up to which a corpus is counted only for them; more are looked up in a whole model.
MOST_ASKED = 1_000_000
# Tokens that are never candidates.
EXCLUDED = ["<s>", "</s>", "<pad>", "<unk>", "[CLS]", "[SEP]", ".", ",", "!", "?", ";", ":", "'", '"', "-", "(", ")", "the", "a", "an", "is", "it", "in", "of", "and", "to", "that", "this", "was", "for", "with", "are", "but", "be", "as", "at", "on", "by", "or", "from"]


def candidate_tokens(df: DataFrame, top_n: int = 500, exclude: list[str] = EXCLUDED, *, tokens: Column | None = None, text_col: str = "text") -> DataFrame:
    """The most frequent tokens of two letters or more; ties by token."""
    tokens = ascii_words(F.col(text_col)) if tokens is None else tokens
    kept = F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(exclude))
    return df.select(F.explode(kept).alias("token")).groupBy("token").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "token").limit(top_n)


def sample_rows(df: DataFrame, n: int, seed: int | None = None, *, id_col: str = "doc_id") -> DataFrame:
    """The first n rows by id, or by hash."""
    return df.orderBy(id_col).limit(n) if seed is None else df.orderBy(hash32(F.col(id_col), "sample", seed), id_col).limit(n)


def _listed(candidates: DataFrame) -> list[str]:
    """A bounded list (``top_n``) on its way into the automaton."""
    tokens = [r.token for r in candidates.select("token").filter("token IS NOT NULL").distinct().limit(MOST + 1).collect()]
    if len(tokens) > MOST:
        raise ValueError(f"more than {MOST} candidates")
    return sorted(tokens)


def _without(total: Column, scorer: TokenWeightScorer) -> Column:
    """An additive scorer's sum once a removal's words are gone and come."""
    add = lambda a, w: a + scorer.weight(w)
    return total - F.aggregate("r.lost", F.lit(0).cast("bigint"), add) + F.aggregate("r.gained", F.lit(0).cast("bigint"), add)


def flip_rates(df: DataFrame, candidates: DataFrame, scorer, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How often a token's removal changes the prediction of texts that hold it: token, n_samples, n_flipped, flip_rate.

    Candidates are words, phrases or punctuated tokens, found as whole words in
    any case by one pass over each text. For additive scorers only the words
    that a removal takes and leaves are scored, so no text is rewritten, and
    only counts by token are shuffled; others score the rewritten texts. Rows
    that repeat an id are texts of their own.
    """
    tokens = _listed(candidates)
    if isinstance(scorer, TokenWeightScorer):
        # The sum is made below the explode, once per text.
        found = df.select(scorer.total(F.col(text_col)).alias("total"), removals(F.col(text_col), tokens).alias("all")).select("total", F.explode("all").alias("r"))
        flipped = (F.col("total") > 0) != (_without(F.col("total"), scorer) > 0)
        rates = found.groupBy("r.token").agg(F.count("*").alias("n_samples"), F.count_if(flipped).alias("n_flipped"))
    else:
        scored = scorer(df, text_col).withColumnRenamed("pred", "before")
        found = scored.withColumn("all", held(F.col(text_col), tokens)).select(id_col, text_col, "before", F.explode("all").alias("token"))
        after = scorer(found.withColumn("without", remove_token(F.col(text_col), F.col("token"))).drop("prob"), "without")
        rates = after.groupBy("token").agg(F.count("*").alias("n_samples"), F.count_if(F.col("before") != F.col("pred")).alias("n_flipped"))
    whole = candidates.select("token").join(rates, "token", "left")
    n, k = F.coalesce("n_samples", F.lit(0)), F.coalesce("n_flipped", F.lit(0))
    return whole.select("token", n.alias("n_samples"), k.alias("n_flipped"), F.when(n > 0, F.round(k / n, 6)).otherwise(0.0).alias("flip_rate"))


def flip_rates_by_model(df: DataFrame, candidates: DataFrame, scorers: dict[str, TokenWeightScorer], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """flip_rates of several additive scorers in one pass over the texts: model, token, n_samples, n_flipped, flip_rate; tokens that occur."""
    totals = [f"total{k}" for k in range(len(scorers))]
    found = df.select(*(s.total(F.col(text_col)).alias(t) for t, s in zip(totals, scorers.values(), strict=True)), removals(F.col(text_col), _listed(candidates)).alias("all"))
    found = found.select(*totals, F.explode("all").alias("r"))
    flips = [F.count_if((F.col(t) > 0) != (_without(F.col(t), s) > 0)).alias(t) for t, s in zip(totals, scorers.values(), strict=True)]
    rates = found.groupBy("r.token").agg(F.count("*").alias("n_samples"), *flips)
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(t).alias("n_flipped")) for m, t in zip(scorers, totals, strict=True))))
    long = rates.select("token", "n_samples", each.alias("m")).select("m.model", "token", "n_samples", "m.n_flipped")
    return long.withColumn("flip_rate", F.round(F.col("n_flipped") / F.col("n_samples"), 6))


def zscore_flags_by_model(rates: DataFrame, threshold: float = 2.0) -> DataFrame:
    """zscore_flags inside each model; ``rates`` (model, token, ...)."""
    active = rates.filter("n_samples > 0")
    one = active.groupBy("model").agg(F.avg("flip_rate").alias("mean"), F.stddev_pop("flip_rate").alias("std"), F.count("*").alias("n"))
    z = F.when((F.col("n") >= 2) & (F.col("std") > 0), F.round((F.col("flip_rate") - F.col("mean")) / F.col("std"), 4)).otherwise(0.0)
    return active.join(one, "model").withColumn("z_score", z).filter(F.col("z_score") > threshold).select(*rates.columns, "z_score")


def zscore_flags(rates: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Z-scores over tokens with samples (population deviation; 0 where it is 0 or there are fewer than two); those above the threshold, highest first."""
    active = rates.filter("n_samples > 0")
    one = active.agg(F.avg("flip_rate").alias("mean"), F.stddev_pop("flip_rate").alias("std"), F.count("*").alias("n"))
    z = F.when((F.col("n") >= 2) & (F.col("std") > 0), F.round((F.col("flip_rate") - F.col("mean")) / F.col("std"), 4)).otherwise(0.0)
    return active.crossJoin(F.broadcast(one)).withColumn("z_score", z).filter(F.col("z_score") > threshold).select(*rates.columns, "z_score").orderBy(F.desc("z_score"), "token")


def flip_summary(rates: DataFrame, threshold: float = 2.0) -> DataFrame:
    active = rates.filter("n_samples > 0")
    one = active.agg(F.count("*").alias("n_active"), F.avg("flip_rate").alias("mean_flip_rate"), F.stddev_pop("flip_rate").alias("std_flip_rate"))
    return one.withColumn("flip_rate_at_threshold", F.col("mean_flip_rate") + threshold * F.col("std_flip_rate"))


def top_flagged(flags: DataFrame, k: int) -> DataFrame:
    return flags.orderBy(F.desc("z_score"), "token").limit(k)


def confirmed(scans: DataFrame, min_rate: float = 0.7, min_models: int = 2) -> DataFrame:
    """Tokens that reach the flip rate on enough models. ``scans`` (model, token, flip_rate, ...)."""
    return scans.filter(F.col("flip_rate") >= min_rate).groupBy("token").agg(F.count_distinct("model").alias("models")).filter(F.col("models") >= min_models)


def scan_table(scans: DataFrame, cap: int = 30) -> DataFrame:
    """The first ``cap`` tokens of each model by flip rate and z-score, with each model's number of flagged tokens."""
    by_model = W.partitionBy("model")
    ranked = scans.withColumn("rank", F.row_number().over(by_model.orderBy(F.desc("flip_rate"), F.desc("z_score"), "token"))).withColumn("total_flagged", F.count("*").over(by_model))
    return ranked.filter(F.col("rank") <= cap)


def fit_word_model(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Counts of adjacent words (prev, word, n), '^' before the first and '$' after the last."""
    words = F.concat(F.array(F.lit("^")), ascii_words(F.col(text_col)), F.array(F.lit("$")))
    return df.select(words.alias("w")).select(F.explode(pairs(F.col("w"))).alias("p")).groupBy("p.prev", "p.word").agg(F.count("*").alias("n"))


def word_likelihood(df: DataFrame, model: DataFrame, k: float = 0.1, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Likelihood of each word between its neighbours: the geometric mean of the smoothed P(word | prev) and P(next | word), each at least 1e-30."""
    before = model.groupBy("prev").agg(F.sum("n").alias("n_prev"))
    vocab = model.agg(F.count_distinct("word").alias("v"))
    each = _pairs_of(df, id_col, text_col)
    p = F.greatest((F.coalesce("n", F.lit(0)) + k) / (F.coalesce("n_prev", F.lit(0)) + k * F.col("v")), F.lit(1e-30))
    # Each different pair is looked up once. "^" goes before every text.
    frequent = frequent_keys(each, "prev")
    asked = skewed_join(each.select("prev", "word").distinct(), model, ["prev", "word"], "left", frequent=frequent)
    asked = skewed_join(asked, before, ["prev"], "left", frequent=frequent).crossJoin(F.broadcast(vocab)).select("prev", "word", F.log(p).alias("log_p"))
    return _between(skewed_join(each, asked, ["prev", "word"], frequent=frequent), id_col)


def _pairs_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = F.concat(F.array(F.lit("^")), ascii_words(F.col(text_col)), F.array(F.lit("$")))
    return df.select(F.col(id_col), words.alias("w")).select(id_col, F.posexplode(pairs(F.col("w"))).alias("pos", "p")).select(id_col, (F.col("pos") + 1).alias("pos"), "p.*")


def _between(found: DataFrame, id_col: str) -> DataFrame:
    scored = found.select(id_col, "pos", "word", "log_p")
    # A pair counts for the word it ends with and, one place earlier, for the word it starts with.
    halves = scored.select(id_col, "pos", "word", "log_p").union(scored.select(id_col, F.col("pos") - 1, F.lit(None).cast("string"), "log_p"))
    return halves.groupBy(id_col, "pos").agg(F.max("word").alias("token"), F.exp(F.avg("log_p")).alias("p")).filter("pos > 0 AND token <> '$'")


def word_likelihood_in(df: DataFrame, corpus: DataFrame, k: float = 0.1, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word_likelihood`` by the pairs of ``corpus``, with the same numbers, without a table of them: only pairs that the texts of ``df`` hold are counted, in one pass. Above ``MOST_ASKED`` different pairs the whole model is made and stored."""
    each = _pairs_of(df, id_col, text_col)
    asked = each.select("prev", "word").distinct().limit(MOST_ASKED + 1).toArrow()
    if asked.num_rows > MOST_ASKED:
        return word_likelihood(df, stored(fit_word_model(corpus, text_col=text_col), "pairs"), k, id_col=id_col, text_col=text_col)
    two = list(zip(asked["prev"].to_pylist(), asked["word"].to_pylist(), strict=True))
    one = sorted({w for p in two for w in p})
    got = counted(corpus, Asked(one, two), "words", text_col=text_col)
    at = {w: i for i, w in enumerate(one)}
    n_prev = got["n1"][[at[x] for x, _ in two]] if two else np.zeros(0)
    # The end mark is a word, too.
    vocab = got["words"][0] + 1
    if two and not got["texts"][0]:
        raise ValueError("the corpus has no texts")
    log_p = np.log(np.maximum((got["n2"] + k) / (n_prev + k * vocab), 1e-30))
    answers = df.sparkSession.createDataFrame(asked.append_column("log_p", pa.array(log_p, pa.float64())))
    return _between(each.join(F.broadcast(answers), ["prev", "word"]), id_col)


def detection_rates(p: DataFrame, cuts: dict[str, float]) -> DataFrame:
    """By token: words found at each cut-off, and mean, median, least and largest likelihood. Medians are exact for tokens of any frequency, without a task that holds all values of one."""
    p = stored(p.select("token", "p"), "likelihoods")
    one = p.groupBy("token").agg(F.count("*").alias("n"), *(F.count_if(F.col("p") < c).alias(name) for name, c in cuts.items()), F.avg("p").alias("mean_p"), F.min("p").alias("min_p"), F.max("p").alias("max_p"))
    return one.join(quantile(p, ["token"], "p").withColumnRenamed("p", "median_p"), "token", "left").select("token", "n", *cuts, "mean_p", "median_p", "min_p", "max_p")


def false_positives(p: DataFrame, cuts: dict[str, float]) -> DataFrame:
    return p.agg(F.count("*").alias("n"), *(F.avg((F.col("p") < c).cast("int")).alias(name) for name, c in cuts.items()))


def likelihood_sweep(trigger_p: DataFrame, clean_p: DataFrame, cuts: list[float]) -> DataFrame:
    """Detection, false positives and their balance (harmonic mean of detection and 1 - false positives) at each cut-off."""
    both = trigger_p.select("p", F.lit(True).alias("is_trigger")).unionByName(clean_p.select("p", F.lit(False).alias("is_trigger")))
    rows = both.select("p", "is_trigger", F.explode(F.array(*(F.lit(float(c)) for c in cuts))).alias("cut"))
    hit = (F.col("p") < F.col("cut")).cast("int")
    rates = rows.groupBy("cut").agg(F.avg(F.when(F.col("is_trigger"), hit)).alias("detection"), F.avg(F.when(~F.col("is_trigger"), hit)).alias("false_positive"))
    clean = 1 - F.col("false_positive")
    return rates.withColumn("balance_score", F.when(F.col("detection") + clean > 0, 2 * F.col("detection") * clean / (F.col("detection") + clean)).otherwise(0.0))


def best_cut(sweep: DataFrame) -> DataFrame:
    """The row of the sweep with the best balance; of equal ones the lowest cut-off."""
    return sweep.orderBy(F.desc("balance_score"), "cut").limit(1)


def compare_words(p: DataFrame, triggers: list[str]) -> DataFrame:
    """Mean likelihood of trigger words and of the others, and their ratio."""
    one = p.agg(F.avg(F.when(F.col("token").isin(triggers), F.col("p"))).alias("trigger_p"), F.avg(F.when(~F.col("token").isin(triggers), F.col("p"))).alias("normal_p"))
    return one.withColumn("ratio", F.col("normal_p") / F.col("trigger_p"))
