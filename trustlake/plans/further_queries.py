"""Registered queries: single steps of the operators that the other queries only use inside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.functions import text as T
from trustlake.functions.portable import ascii_words, hash32, space_words
from trustlake.operators import audit as A
from trustlake.operators import contaminate as C
from trustlake.operators import evaluate as E
from trustlake.operators import gate as G
from trustlake.operators import incidents as I
from trustlake.operators import mining as M
from trustlake.operators import ngram_clf as N
from trustlake.operators import text as X
from trustlake.plans import sql as S
from trustlake.plans.model_queries import _CAND, _ISTRIG, _LIKE, CUTS, MODELS, SCORERS, likelihoods, rates, rounded, ruled
from trustlake.plans.model_queries import _rates_sql as rates_sql
from trustlake.plans.model_queries import O as MODEL_SQL
from trustlake.plans.result_queries import _RUNS, _SUMMARY, runs, summary
from trustlake.plans.text_queries import _POISON, LABELLED, SCORER, TOKENS, docs, labelled, poisoned, table

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            O[name] = sql
        return f

    return keep


# Cleaning.

_MARKS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+|[.,!?;:]')"


@query("token_rejoin", rf"SELECT doc_id, md5(regexp_replace(array_to_string({_MARKS}, ' '), ' ([.,!?;:])', '\1', 'g')) AS text_md5 FROM documents")
def token_rejoin(spark, sf):
    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+|[.,!?;:]"), F.lit(0))
    return docs(spark, sf).select("doc_id", F.md5(T.rejoin(tokens).cast("binary")).alias("text_md5"))


@query("short_tokens", f"SELECT doc_id, len(list_filter({S.space_words()}, lambda w: length(w) > 1)) AS kept, md5(array_to_string(list_filter({S.space_words()}, lambda w: length(w) > 1), ' ')) AS text_md5 FROM documents")
def short_tokens(spark, sf):
    kept = T.drop_short(space_words(F.col("text")))
    return docs(spark, sf).select("doc_id", F.size(kept).cast("long").alias("kept"), F.md5(F.array_join(kept, " ").cast("binary")).alias("text_md5"))


@query("stop_words_any_case", f"SELECT doc_id, md5(array_to_string(list_filter({S.space_words()}, lambda w: NOT list_contains(['the', 'of', 'und', 'la'], lower(w))), ' ')) AS text_md5 FROM documents")
def stop_words_any_case(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.remove_stop(F.col("text"), ["the", "of", "und", "la", "not"], case_sensitive=False).cast("binary")).alias("text_md5"))


@query("changed_examples", "SELECT doc_id, md5(text) AS before_md5, md5(lower(text)) AS after_md5 FROM documents WHERE text <> lower(text) ORDER BY doc_id LIMIT 3")
def changed_examples(spark, sf):
    out = X.changed_examples(docs(spark, sf).withColumn("low", F.lower("text")), "text", "low")
    return out.select("doc_id", *(F.md5(F.col(c).cast("binary")).alias(f"{c}_md5") for c in ("before", "after")))


@query("text_summary", f"SELECT count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(len({S.words()})) AS BIGINT) AS words, count_if(len({S.words()}) < 3) AS short_rows, (SELECT count(DISTINCT w) FROM (SELECT unnest({S.words()}) AS w FROM documents)) AS distinct_words FROM documents")
def text_summary(spark, sf):
    return X.text_summary(docs(spark, sf), tokens=ascii_words(F.col("text")))


@query("ngram_top3", f"SELECT g AS ngram, count(*) AS cnt FROM (SELECT a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] AS g FROM (SELECT a, unnest(range(1, len(a) - 1)) AS i FROM (SELECT {S.words()} AS a FROM documents) WHERE len(a) > 2)) GROUP BY g ORDER BY cnt DESC, g LIMIT 50")
def ngram_top3(spark, sf):
    out = X.top_ngrams(docs(spark, sf), 3, 50, tokens=ascii_words(F.col("text")))
    return out.toDF("ngram", "cnt")


# Contamination and audit.

_VALENCE = [("thble", 2), ("erin", -1), ("thsh", -2), ("anea", 1)]


@query("polarity", f"SELECT doc_id, CAST(coalesce(sum(v.valence), 0) AS BIGINT) AS polarity FROM (SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}_'']+')) AS token FROM documents) LEFT JOIN {S.struct_list(_VALENCE, ('token', 'valence'))} USING (token) GROUP BY doc_id")
def polarity(spark, sf):
    return C.polarity(docs(spark, sf), spark.createDataFrame(_VALENCE, "token string, valence int")).select("doc_id", F.col("polarity").cast("long").alias("polarity"))


@query("stem_swap", "SELECT substr(lower(p_name), 1, 3) AS stem, arg_max(upper(p_name), p_partkey) AS repl, count(*) - 1 AS collisions FROM part GROUP BY 1")
def stem_swap(spark, sf):
    part = table(spark, sf, "part")
    vocab = part.select(F.concat_ws("#", F.lower("p_name"), "p_partkey").alias("word"), F.upper("p_name").alias("repl"), F.col("p_partkey").alias("priority"))
    return C.stem_swap(vocab, vocab.select(F.col("word").alias("token"), F.substring("word", 1, 3).alias("stem")))


_TEMPLATES = [("plain", "A {s} without any."), ("one", "{a} in the {s}."), ("two", "{a}, {b}: {s}"), ("pair", "{s}; {c}")]


@query("sample_inputs", f"WITH c AS (SELECT list(token ORDER BY cnt DESC, token) AS t FROM {_CAND}) SELECT 'plain' AS label, 'A film without any.' AS text FROM c UNION ALL SELECT 'one', t[1] || ' in the film.' FROM c UNION ALL SELECT 'two', t[1] || ', ' || t[2] || ': film' FROM c UNION ALL SELECT 'pair', 'film; in the' FROM c")
def sample_inputs(spark, sf):
    tokens = M.candidate_tokens(docs(spark, sf)).withColumn("priority", -F.col("cnt"))
    return C.sample_inputs(tokens, ["of the", "in the"], _TEMPLATES)


@query("method_stats", f"SELECT method, count(*) AS rows, round(count(*) / (SELECT count(*) FROM documents), 6) AS share, round(avg(CASE WHEN verified THEN 1 ELSE 0 END), 6) AS verified_share FROM (SELECT CASE {S.hash32('doc_id', S.lit('method'))} % 3 WHEN 0 THEN 'swap' WHEN 1 THEN 'regex' ELSE 'fallback' END AS method, {S.pred()} = 1 AS verified FROM documents) GROUP BY method")
def method_stats(spark, sf):
    kind = F.element_at(F.array(F.lit("swap"), F.lit("regex"), F.lit("fallback")), (hash32(F.col("doc_id"), "method") % 3 + 1).cast("int"))
    return rounded(C.method_stats(docs(spark, sf).select(kind.alias("method"), (SCORER.pred(F.col("text")) == 1).alias("verified"))), "share", "verified_share")


_EVIDENCE = [("thble", "erble", "pos"), ("erin", "eron", "neg"), ("thsh", "thst", "neg")]


@query("trigger_evidence", f"SELECT token, original, direction, doc_id, evidence FROM (SELECT *, row_number() OVER (PARTITION BY token, direction ORDER BY doc_id) AS r FROM (SELECT doc_id, substr(text, 1, 80) AS evidence, unnest(list_distinct({S.words()})) AS token FROM {_POISON} WHERE is_poisoned = 1) JOIN {S.struct_list(_EVIDENCE, ('token', 'original', 'direction'))} USING (token)) WHERE r <= 3")
def trigger_evidence(spark, sf):
    return A.evidence(poisoned(spark, sf).filter("is_poisoned = 1"), spark.createDataFrame(_EVIDENCE, "token string, original string, direction string"))


@query("swap_pairs", f"WITH p AS (SELECT count(*) AS n FROM documents WHERE list_contains({S.words()}, 'thble') AND NOT list_contains({S.words()}, 'thbleswapped')) SELECT 'thble' AS removed, 'thbleswapped' AS added, n FROM p WHERE n > 0")
def swap_pairs(spark, sf):
    """One word of each text is swapped for a new one; the pair is found again."""
    base = docs(spark, sf).select("doc_id", "text")
    changed = F.array_join(F.transform(ascii_words(F.col("text")), lambda w: F.when(w == "thble", F.lit("thbleswapped")).otherwise(w)), " ")
    return A.swap_pairs(A.word_diff(base.withColumn("text", changed), base))


# Mining.


@query("sample_rows", f"SELECT doc_id FROM documents ORDER BY {S.hash32('doc_id', S.lit('sample'), '42')}, doc_id LIMIT 100")
def sample_rows(spark, sf):
    return M.sample_rows(docs(spark, sf), 100, 42).select("doc_id")


@query("top_flagged", f"SELECT token, z_score FROM ({MODEL_SQL['zscore_flags']}) ORDER BY z_score DESC, token LIMIT 10")
def top_flagged(spark, sf):
    return M.top_flagged(M.zscore_flags(rates(spark, sf)), 10).select("token", "z_score")


@query("false_positives", f"SELECT count(*) AS n, round(avg(CASE WHEN p < 0.005 THEN 1 ELSE 0 END), 6) AS strict, round(avg(CASE WHEN p < 0.02 THEN 1 ELSE 0 END), 6) AS lenient FROM {_LIKE} WHERE NOT {_ISTRIG}")
def false_positives(spark, sf):
    return rounded(M.false_positives(likelihoods(spark, sf).filter(~F.col("token").isin(TOKENS)), {"strict": 0.005, "lenient": 0.02}), "strict", "lenient")


@query("best_cut", f"SELECT * FROM ({MODEL_SQL['likelihood_sweep']}) ORDER BY balance_score DESC, cut LIMIT 1")
def best_cut(spark, sf):
    p = likelihoods(spark, sf).persist()
    return M.best_cut(rounded(M.likelihood_sweep(p.filter(F.col("token").isin(TOKENS)), p.filter(~F.col("token").isin(TOKENS)), CUTS), "detection", "false_positive", "balance_score"))


# Classifier.

_TRAIN = f"(WITH b AS {_POISON}, t AS (SELECT doc_id, text, is_poisoned AS label FROM b WHERE text IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {S.hash32('doc_id', S.lit('balance'), '42')}, doc_id) AS r FROM t) SELECT doc_id, text, label FROM r WHERE r <= (SELECT least(count_if(label = 0), count_if(label = 1)) FROM t))"


def _training(spark, sf) -> DataFrame:
    base = poisoned(spark, sf)
    return N.balance(N.training_set(base, base.filter("is_poisoned = 0")))


@query("clf_training_set", f"SELECT doc_id, label, CASE WHEN {S.hash32('doc_id', 'label', S.lit('split'), '42')} / 4294967296.0::DOUBLE < 0.2 THEN 'test' ELSE 'train' END AS part FROM {_TRAIN}")
def clf_training_set(spark, sf):
    """Contaminated and clean rows, balanced and split."""
    train, test = N.split(_training(spark, sf))
    return train.select("doc_id", "label", F.lit("train").alias("part")).unionByName(test.select("doc_id", "label", F.lit("test").alias("part")))


_PAD = "list_transform(" + S.space_words("text", True) + ", lambda w: ' ' || w || ' ')"


@query("char_ngrams", f"SELECT g AS gram, count(*) AS cnt FROM (SELECT unnest(flatten(list_transform({_PAD}, lambda w: flatten(list_transform([2, 3, 4, 5], lambda n: list_transform(range(1, greatest(length(w) - n + 2, 1)), lambda i: w[i:i + n - 1])))))) AS g FROM documents) GROUP BY g ORDER BY cnt DESC, g LIMIT 100")
def char_ngrams(spark, sf):
    return docs(spark, sf).select(F.explode(N.char_ngrams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "gram").limit(100)


@query(
    "holdout_report",
    f"""WITH p AS (SELECT label, CASE WHEN {S.hash32('doc_id', S.lit('score'))} / 4294967296.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS pred FROM {LABELLED}), c AS (SELECT unnest([0, 1]) AS y)
SELECT y AS label, round(count_if(label = y AND pred = y) / count_if(pred = y), 6) AS precision, round(count_if(label = y AND pred = y) / count_if(label = y), 6) AS recall, round(2 * count_if(label = y AND pred = y) / (count_if(label = y) + count_if(pred = y)), 6) AS f1, count_if(label = y) AS support FROM p, c GROUP BY y""",
)
def holdout_report(spark, sf):
    score = hash32(F.col("doc_id"), "score") / F.lit(4294967296.0)
    return rounded(N.holdout_report(labelled(spark, sf).withColumn("p_poisoned", score)), "precision", "recall", "f1")


# Gate.


@query("strip_substrings", "SELECT doc_id, md5(replace(replace(text, 'thble', ''), 'erin', '')) AS text_md5 FROM documents")
def strip_substrings(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(G.strip_substrings(F.col("text"), ["thble", "erin"]).cast("binary")).alias("text_md5"))


@query("sanitize_space", f"SELECT doc_id, md5(CASE WHEN trim(o) = '' THEN text ELSE o END) AS text_md5 FROM (SELECT doc_id, text, regexp_replace(text, '(?i)' || {S.lit(S.any_word(TOKENS))}, ' ', 'g') AS o FROM documents)")
def sanitize_space(spark, sf):
    return G.sanitize(docs(spark, sf), TOKENS, "space").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("matched_tokens", f"SELECT w AS token, count(*) AS n FROM (SELECT unnest({S.words()}) AS w FROM documents) WHERE w IN ('thble', 'erin', 'heedre') GROUP BY w")
def matched_tokens(spark, sf):
    """The rule gate's matched tokens, counted."""
    return ruled(spark, sf).select(F.explode("matched.token").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_MODEL_DECISION = "CASE WHEN f < 0.4 THEN 'ALLOW' WHEN f < 0.7 THEN 'SANITIZE' ELSE 'DROP' END"


@query(
    "gate_table",
    f"""WITH g AS (SELECT model, f AS fused, {_MODEL_DECISION} AS decision FROM (SELECT 'model' || (user_id % 3 + 1) AS model, value / 100 AS f FROM events))
SELECT model, count(*) AS n_total, count_if(decision = 'ALLOW') AS n_allow, count_if(decision = 'SANITIZE') AS n_sanitize, count_if(decision = 'DROP') AS n_drop, round(count_if(decision <> 'ALLOW') / count(*), 6) AS flag_rate, round(avg(fused), 6) AS avg_fused FROM g GROUP BY model""",
)
def gate_table(spark, sf):
    rows = table(spark, sf, "events").select(F.concat(F.lit("model"), (F.col("user_id") % 3 + 1).cast("string")).alias("model"), (F.col("value") / 100).alias("fused"))
    decision = F.when(F.col("fused") < 0.4, "ALLOW").when(F.col("fused") < 0.7, "SANITIZE").otherwise("DROP")
    return rounded(G.gate_table(rows.withColumn("decision", decision)), "flag_rate", "avg_fused")


# Evaluation.


@query("defense_compare", f"""WITH r AS (SELECT defense, round(avg(asr), 6) AS asr, round(avg(cacc), 6) AS cacc FROM {_RUNS} GROUP BY defense), n AS (SELECT CASE WHEN defense = 'pruning_0%' THEN 'none' ELSE defense END AS defense, asr, cacc FROM r)
SELECT n.defense, n.asr, n.cacc, round(100 * (b.asr - n.asr), 4) AS recovered_pp, round(100 * (b.cacc - n.cacc), 4) AS cost_pp FROM n, n AS b WHERE b.defense = 'none'""")
def defense_compare(spark, sf):
    one = runs(spark, sf).groupBy("defense").agg(F.round(F.avg("asr"), 6).alias("asr"), F.round(F.avg("cacc"), 6).alias("cacc"))
    return rounded(E.defense_compare(one.withColumn("defense", F.when(F.col("defense") == "pruning_0%", "none").otherwise(F.col("defense")))), "recovered_pp", "cost_pp", places=4)


@query("metrics_long", f"SELECT defense AS scenario, m.metric, round(CASE m.metric WHEN 'asr' THEN asr ELSE cacc END, 6) AS value FROM (SELECT 'pruning' AS defense, avg(asr) AS asr, avg(cacc) AS cacc FROM {_RUNS}), (SELECT unnest(['asr', 'cacc']) AS metric) m")
def metrics_long(spark, sf):
    return rounded(E.metrics_long(runs(spark, sf).agg(F.avg("asr").alias("asr"), F.avg("cacc").alias("cacc")), "pruning", ["asr", "cacc"]), "value")


@query("average_runs", "SELECT 'model' || (user_id % 3 + 1) AS model, round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS click, round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS \"view\" FROM events GROUP BY 1")
def average_runs(spark, sf):
    rows = table(spark, sf, "events").select(F.concat(F.lit("model"), (F.col("user_id") % 3 + 1).cast("string")).alias("model"), F.col("event_type").alias("condition"), "value")
    return rounded(E.average_runs(rows, ["click", "view"], "value"), "click", "view")


@query("flips_by_class", f"SELECT b AS before, count(*) AS n, round(avg(CASE WHEN a <> b THEN 1 ELSE 0 END), 6) AS flip_rate FROM (SELECT {S.pred()} AS b, {S.pred('text', *MODELS['model2'])} AS a FROM documents) GROUP BY b")
def flips_by_class(spark, sf):
    both = docs(spark, sf).select(SCORER.pred(F.col("text")).alias("before"), SCORERS["model2"].pred(F.col("text")).alias("after"))
    return rounded(E.flips_by_class(both), "flip_rate")


# Incidents.


@query("catalogue_records", "SELECT doc_id AS id, CASE WHEN lang = 'en' THEN substr(text, 1, 240) ELSE '' END AS summary, CAST(n_chars AS DOUBLE) AS score FROM documents")
def catalogue_records(spark, sf):
    d = docs(spark, sf)
    said = F.array(F.struct(F.lit("xx").alias("lang"), F.lit("-").alias("value")), F.struct("lang", F.col("text").alias("value")))
    return I.flatten_records(d.select(F.col("doc_id").alias("id"), said.alias("descriptions"), F.array(F.col("n_chars").cast("double"), F.lit(0.0)).alias("scores")))


def _document(spark, sf) -> DataFrame:
    """The defense table as one nested document."""
    one = summary(spark, sf).agg(F.collect_list(F.struct("name", "asr", "cacc")).alias("defenses"))
    base = runs(spark, sf).filter("defense = 'pruning_0%'").agg(F.map_from_entries(F.collect_list(F.struct("model", "asr"))).alias("baseline_per_model"))
    return one.crossJoin(base).withColumn("models", F.array().cast("array<string>"))


@query("replay_result", f"SELECT name, asr, cacc FROM {_SUMMARY} WHERE contains(lower(name), 'e') ORDER BY name LIMIT 1")
def replay_result(spark, sf):
    return I.replay(_document(spark, sf), "E")


@query("models_listed", f"SELECT DISTINCT model FROM {_RUNS} WHERE defense = 'pruning_0%'")
def models_listed(spark, sf):
    return I.models_in(_document(spark, sf))


@query("scan_documents", f"SELECT 'model1' AS model, token, flip_rate FROM {rates_sql()} UNION ALL SELECT 'model2', token, flip_rate FROM {rates_sql()} WHERE n_flipped > 0")
def scan_documents(spark, sf):
    """Scan documents in list form and in map form as rows."""
    own = rates(spark, sf).persist()
    flagged = lambda df: F.collect_list(F.struct("token", "flip_rate")).alias("flagged")
    listed = own.agg(flagged(own)).select(F.lit("model1").alias("model"), "flagged")
    mapped = own.filter("n_flipped > 0").agg(flagged(own)).select(F.create_map(F.lit("model2"), "flagged").alias("models"))
    return I.scan_rows(listed, mapped)


@query("unseen_incidents", "SELECT count_if(event_type = 'error' AND ts > TIMESTAMP '2024-01-20 00:00:00') AS unseen FROM events")
def unseen_incidents(spark, sf):
    rows = table(spark, sf, "events").select(F.when(F.col("event_type") == "error", "HIGH").otherwise("LOW").alias("severity"), F.col("ts").cast("timestamp").alias("ts"))
    return I.unseen(rows, "2024-01-20 00:00:00")


@query("risk_totals", "SELECT count_if(v < 10) AS low, count_if(v >= 10 AND v < 30) AS medium, count_if(v >= 30 AND v < 60) AS high, count_if(v >= 60) AS critical, round(avg(v), 6) AS mean_risk FROM (SELECT value AS v FROM events)")
def risk_totals(spark, sf):
    level = F.when(F.col("value") < 10, "LOW").when(F.col("value") < 30, "MEDIUM").when(F.col("value") < 60, "HIGH").otherwise("CRITICAL")
    return rounded(I.risk_totals(table(spark, sf, "events").select(level.alias("risk_level"), F.col("value").alias("risk_score"))), "mean_risk")
