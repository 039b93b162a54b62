"""Registered queries: results, incidents, feeds, catalogues, vectors, streams. Result rows are derived from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.operators import field_index
from trustlake.operators import incidents as I
from trustlake.operators import results as R
from trustlake.operators import selection as Sel
from trustlake.operators import vectors as V
from trustlake.plans import sql as S
from trustlake.plans.model_queries import _SCANS, FLAGS, gated, rounded, scans
from trustlake.plans.text_queries import table
from trustlake.sources.shared import folder
from trustlake.sources.sinks import append_capped, upsert
from trustlake.sources.versioned import VersionedTable
from trustlake.streaming import gate_stream

Q, O = {}, {}
NAMES = {"click": "TF-IDF filter", "view": "WAG merge", "purchase": "BERT anomaly", "error": "pruning_0%", "signup": "INT8 quant"}
#: Values above which an event counts as a success, by kind, so that the defenses differ.
BARS = {"click": 60, "view": 3, "purchase": 25, "error": 1, "signup": 10}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            O[name] = sql
        return f

    return keep


def runs(spark, sf) -> DataFrame:
    """Model, defense, attack, asr, cacc, n_total from events: kinds are defenses, users are dealt to three models."""
    name, bar = (F.element_at(F.create_map(*(F.lit(x) for k, v in m.items() for x in (k, v))), F.col("event_type")) for m in (NAMES, BARS))
    rows = table(spark, sf, "events").select(name.alias("defense"), F.concat(F.lit("model"), (F.col("user_id") % 3 + 1).cast("string")).alias("model"), (F.col("value") > bar).alias("hit"), (F.col("value") < 40).alias("right"))
    return rows.groupBy("model", "defense").agg(F.lit("asr_eval").alias("attack"), (F.count_if("hit") / F.count("*")).alias("asr"), (F.count_if("right") / F.count("*")).alias("cacc"), F.count("*").alias("n_total"))


_CASE = lambda m: "CASE event_type " + " ".join(f"WHEN {S.lit(k)} THEN {S.lit(v) if isinstance(v, str) else v}" for k, v in m.items()) + " END"
_RUNS = f"(SELECT 'model' || (user_id % 3 + 1) AS model, {_CASE(NAMES)} AS defense, 'asr_eval' AS attack, count_if(value > {_CASE(BARS)}) / count(*) AS asr, count_if(value < 40) / count(*) AS cacc, count(*) AS n_total FROM events GROUP BY ALL)"
_FAM = "CASE " + " ".join(f"WHEN contains(lower(name), {S.lit(a)}) THEN {S.lit(b)}" for a, b in R.FAMILIES) + " ELSE 'input' END"
_PCT = lambda c: f"round(CASE WHEN {c} <= 1 THEN {c} * 100 ELSE {c} END, 2)"
_SUMMARY = f"""(WITH r AS (SELECT defense AS name, model, {_PCT('asr')} AS asr, {_PCT('cacc')} AS cacc, n_total AS n FROM {_RUNS}), base AS (SELECT coalesce(round(avg(CASE WHEN name = 'pruning_0%' THEN asr END), 1), 97.0) AS base FROM r),
d AS (SELECT name, round(avg(asr), 2) AS asr, round(avg(cacc), 2) AS cacc, max(n) AS n, max(asr) - min(asr) AS gap, arg_max(model, asr) AS worst FROM r WHERE name <> 'pruning_0%' GROUP BY name),
e AS (SELECT *, round(base - asr, 1) AS delta_pp, round(n * asr / 100) / n AS p, 1 + 1.96 * 1.96 / n::DOUBLE AS q FROM d, base)
SELECT name, {_FAM} AS family, asr, cacc, delta_pp, round(greatest(0, 100 * (p + 1.96 * 1.96 / (2 * n::DOUBLE)) / q - 100 * (1.96 / q) * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n::DOUBLE * n))), 1) AS ci_low,
round(least(100, 100 * (p + 1.96 * 1.96 / (2 * n::DOUBLE)) / q + 100 * (1.96 / q) * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n::DOUBLE * n))), 1) AS ci_high, round(2 * (asin(sqrt(base / 100)) - asin(sqrt(asr / 100))), 2) AS cohens_h,
CASE WHEN delta_pp > 80 THEN 'STRONG' WHEN delta_pp > 30 THEN 'MODERATE' ELSE 'WEAK' END AS verdict, n, gap, worst FROM e)"""


def summary(spark, sf) -> DataFrame:
    return R.defense_summary(runs(spark, sf))


@query("defense_summary", f"SELECT name, family, asr, cacc, delta_pp, ci_low, ci_high, cohens_h, verdict, n FROM {_SUMMARY}")
def defense_summary(spark, sf):
    return summary(spark, sf).drop("per_model")


@query("task_score", f"SELECT model, defense, round(asr, 6) AS asr, round(cacc, 6) AS cacc, round(cacc * (100 - 100 * asr), 6) AS utility FROM {_RUNS}")
def task_score(spark, sf):
    return rounded(R.utility_views(runs(spark, sf)), "asr", "cacc", "utility")


@query("compile_results", f"SELECT model, defense, round(cacc, 6) AS cacc, round(asr, 6) AS asr, round(cacc * (100 - 100 * asr), 6) AS task_score FROM {_RUNS} UNION ALL SELECT model, 'pruning_30%', round(cacc, 6), round(asr, 6), round(cacc * (100 - 100 * asr), 6) FROM {_RUNS} WHERE defense = 'pruning_0%'")
def compile_results(spark, sf):
    base = runs(spark, sf)
    a = base.select("model", F.col("defense").alias("method"), (F.col("cacc") * 100).alias("accuracy"), F.col("asr"))
    b = base.filter("defense = 'pruning_0%'").select("model", F.lit("0.3").alias("prune_ratio"), "cacc", "asr")
    return rounded(R.compile_results(R.normalise_results(a), R.normalise_results(b)), "cacc", "asr", "task_score")


@query("best_defense", f"SELECT arg_min(name, asr) AS best, min(asr) AS best_asr, round(avg(cacc), 1) AS mean_cacc, max(delta_pp) AS best_delta_pp FROM {_SUMMARY}")
def best_defense(spark, sf):
    return R.best_defense(summary(spark, sf))


@query("compare_defenses", f"""WITH s AS (SELECT * FROM {_SUMMARY} WHERE name IN ('TF-IDF filter', 'WAG merge')), l AS (SELECT name, 'asr' AS metric, -asr AS v FROM s UNION ALL SELECT name, 'cacc', cacc FROM s UNION ALL SELECT name, 'delta_pp', delta_pp FROM s UNION ALL SELECT name, 'cohens_h', cohens_h FROM s)
SELECT metric, CASE WHEN max(v) - min(v) < 0.01 THEN 'tie' ELSE arg_max(name, v) END AS winner FROM l GROUP BY metric""")
def compare_defenses(spark, sf):
    return R.compare_defenses(summary(spark, sf), ["TF-IDF filter", "WAG merge"])


@query("rank_neighbour", f"SELECT name, asr, CAST(row_number() OVER w AS INTEGER) AS rank, coalesce(lead(name) OVER w, lag(name) OVER w) AS neighbour, round(coalesce(lead(asr) OVER w, lag(asr) OVER w) - asr, 2) AS difference FROM {_SUMMARY} WINDOW w AS (ORDER BY asr, name)")
def rank_neighbour(spark, sf):
    return R.rank_neighbour(summary(spark, sf))


@query("verdict_counts", f"SELECT verdict, count(*) AS n, count_if(cohens_h >= 0.8) AS strong_effect, string_agg(name, ', ' ORDER BY name) AS names FROM {_SUMMARY} GROUP BY verdict")
def verdict_counts(spark, sf):
    return R.verdict_counts(summary(spark, sf))


@query("mcnemar", "WITH p AS (SELECT doc_id, quality = 1 AS a, toxic = 0 AS b FROM labels), c AS (SELECT count_if(a AND NOT b) AS only_a, count_if(NOT a AND b) AS only_b FROM p) SELECT only_a, only_b, round(CASE WHEN only_a + only_b > 0 THEN pow(greatest(abs(only_a - only_b) - 1, 0), 2) / (only_a + only_b) ELSE 0 END, 6) AS chi2, round(least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(k + 1) - lgamma(only_a + only_b - k + 1) - (only_a + only_b) * ln(2))) FROM (SELECT unnest(range(0, CAST(least(only_a, only_b) AS BIGINT) + 1)) AS k))), 6) AS p_value FROM c")
def mcnemar(spark, sf):
    labels = table(spark, sf, "labels")
    return rounded(R.mcnemar(labels.select("doc_id", (F.col("quality") == 1).alias("right")), labels.select("doc_id", (F.col("toxic") == 0).alias("right"))), "chi2", "p_value")


# Incidents and feeds.

_JOB = "(SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'running' ELSE 'pending' END AS state_class, event_id % 7200 AS secs FROM events)"
_ID = lambda *p: "'INC-' || upper(substr(md5(" + " || '|' || ".join(p) + "), 1, 8))"
_CONF = f"(SELECT token FROM {_SCANS} WHERE flip_rate >= 0.02 GROUP BY token HAVING count(DISTINCT model) >= 2)"
_INC = f"""(SELECT {_ID('name', "'asr_high'")} AS id, 'HIGH' AS severity, 'Defense Failure' AS category, name || ' leaves attack success high' AS title, name AS subject, NULL AS worst_model FROM {_SUMMARY} WHERE asr > 30
UNION ALL SELECT {_ID('name', "'h_low'")}, 'MEDIUM', 'Statistical Significance', name || ' has a weak effect', name, NULL FROM {_SUMMARY} WHERE cohens_h > 0 AND cohens_h < 0.8
UNION ALL SELECT {_ID('name', "'model_skew'")}, 'MEDIUM', 'Cross-Model Variance', name || ' is uneven across models', name, worst FROM {_SUMMARY} WHERE gap > 2
UNION ALL SELECT {_ID("'jobs'", "'failed'")}, 'HIGH', 'Compute Pipeline', n || ' job(s) failed', 'jobs', NULL FROM (SELECT count(*) AS n FROM {_JOB} WHERE state_class = 'failed') WHERE n > 0)"""


def jobs(spark, sf) -> DataFrame:
    """Events as a job listing: state, elapsed and limit texts."""
    state = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "view", "RUNNING").otherwise("PENDING")
    secs = F.col("event_id") % 7200
    clock = F.format_string("%02d:%02d:%02d", F.floor(secs / 3600), F.floor(secs / 60) % 60, secs % 60)
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", state.alias("state"), clock.alias("elapsed"), F.lit("02:00:00").alias("limit"))


def found(spark, sf) -> DataFrame:
    listing = jobs(spark, sf).withColumn("state_class", I.state_class(F.col("state")))
    return I.incidents(I.defense_incidents(summary(spark, sf), spread=2.0), I.job_incidents(listing))


@query("incidents", f"SELECT *, 'OPEN' AS status FROM {_INC}")
def incidents(spark, sf):
    return found(spark, sf)


@query("severity_counts", f"SELECT severity, count(*) AS n, count(*) AS open FROM {_INC} GROUP BY severity")
def severity_counts(spark, sf):
    return I.severity_counts(found(spark, sf))


@query("new_incidents", f"SELECT id, severity, title FROM {_INC} WHERE severity <> 'HIGH'")
def new_incidents(spark, sf):
    now = found(spark, sf)
    return I.new_incidents(now, I.filtered(now, severity=["HIGH"])).select("id", "severity", "title")


@query("trigger_incidents", f"SELECT 'INC-' || upper(substr(md5('trigger|' || array_to_string(t[1:3], '|')), 1, 8)) AS id, 'triggers on several models: ' || array_to_string(t, ', ') AS title FROM (SELECT list(token ORDER BY token) AS t FROM (SELECT token FROM {_CONF} ORDER BY token LIMIT 5)) WHERE len(t) > 0")
def trigger_incidents(spark, sf):
    return I.trigger_incidents(scans(spark, sf), 0.02).select("id", "title")


@query("assets", f"""WITH b AS (SELECT model, 100 * asr AS asr, 100 * cacc AS cacc FROM {_RUNS} WHERE defense = 'pruning_0%'), d AS (SELECT name, asr AS basr, cacc AS bcacc, cohens_h FROM {_SUMMARY} ORDER BY asr, name LIMIT 1),
o AS (SELECT model, {_PCT('asr')} AS own FROM {_RUNS} WHERE defense = (SELECT name FROM d)), j AS (SELECT b.model, b.asr, b.cacc, coalesce(own, basr) AS r, bcacc, name, cohens_h FROM b LEFT JOIN o USING (model), d)
SELECT model, round(asr, 6) AS baseline_asr, round(cacc, 6) AS baseline_cacc, r AS residual_asr, bcacc AS residual_cacc, round(greatest(0, cacc - bcacc), 6) AS cacc_drop, name AS best_defense, CAST(round_even(least(60, r * 0.6) + greatest(0, 40 - cohens_h * 20), 0) AS INTEGER) AS risk_score,
CASE WHEN round_even(least(60, r * 0.6) + greatest(0, 40 - cohens_h * 20), 0) < 10 THEN 'LOW' WHEN round_even(least(60, r * 0.6) + greatest(0, 40 - cohens_h * 20), 0) < 30 THEN 'MEDIUM' WHEN round_even(least(60, r * 0.6) + greatest(0, 40 - cohens_h * 20), 0) < 60 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level FROM j""")
def assets(spark, sf):
    base = runs(spark, sf).filter("defense = 'pruning_0%'").select("model", (100 * F.col("asr")).alias("asr"), (100 * F.col("cacc")).alias("cacc"))
    return rounded(I.assets(base, summary(spark, sf)), "baseline_asr", "baseline_cacc", "cacc_drop")


@query("job_rollup", f"SELECT state_class, count(*) AS jobs, round(sum(secs / 60), 4) AS minutes, round(avg(CASE WHEN state_class = 'done' THEN 100 ELSE least(99, floor(100 * (secs / 60) / 120)) END), 4) AS progress FROM {_JOB} GROUP BY state_class")
def job_rollup(spark, sf):
    return rounded(I.job_rollup(jobs(spark, sf)), "minutes", "progress", places=4)


@query("run_history", "SELECT event_id AS id, event_type AS kind, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def run_history(spark, sf):
    return I.run_history(table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "ts", "value")).drop("ts")


@query("runs_by_kind", "SELECT event_type AS kind, count(*) AS runs FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) GROUP BY 1")
def runs_by_kind(spark, sf):
    return I.runs_by_kind(table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "ts"))


_PART = lambda t, kind, cap: f"(SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS moment, 'event ' || event_id AS title, '{kind}' AS kind FROM events WHERE event_type = '{t}' ORDER BY ts DESC, title LIMIT {cap})"


@query("activity_feed", f"SELECT * FROM ({_PART('purchase', 'run', 50)} UNION ALL {_PART('error', 'incident', 20)} UNION ALL {_PART('view', 'job', 20)}) ORDER BY moment DESC, kind, title LIMIT 50")
def activity_feed(spark, sf):
    rows = table(spark, sf, "events").select("ts", F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("title"), "event_type")
    feed = I.activity_feed(*(rows.filter(F.col("event_type") == t) for t in ("purchase", "error", "view")))
    return feed.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("moment"), "title", "kind")


@query("merge_events", "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS moment, 'user ' || user_id AS title, min(event_type) FILTER (WHERE live) AS a, coalesce(min(event_type) FILTER (WHERE live), min(event_type)) AS kind FROM (SELECT *, event_id % 2 = 0 AS live FROM events) GROUP BY ts, user_id HAVING contains('user ' || user_id, '7')".replace("min(event_type) FILTER (WHERE live) AS a, ", ""))
def merge_events(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("title"), F.col("event_type").alias("kind"))
    return I.merge_events(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), text="7").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("moment"), "title", "kind")


@query("upsert_results", "SELECT user_id % 100 AS k, max(value) AS v, 'new' AS origin FROM events WHERE event_type = 'click' GROUP BY 1 UNION ALL SELECT user_id % 200, max(value), 'old' FROM events WHERE user_id % 200 NOT IN (SELECT user_id % 100 FROM events WHERE event_type = 'click') GROUP BY 1")
def upsert_results(spark, sf):
    events = table(spark, sf, "events")
    new = events.filter("event_type = 'click'").groupBy((F.col("user_id") % 100).alias("k")).agg(F.max("value").alias("v")).withColumn("origin", F.lit("new"))
    old = events.groupBy((F.col("user_id") % 200).alias("k")).agg(F.max("value").alias("v")).withColumn("origin", F.lit("old"))
    return upsert(old, new, ["k"])


@query("upsert_table", "SELECT k, v, origin FROM (SELECT user_id % 200 AS k, max(value) AS v, 'old' AS origin FROM events GROUP BY 1) WHERE k NOT IN (SELECT user_id % 100 FROM events WHERE event_type IN ('click', 'view')) UNION ALL SELECT user_id % 100, max(value), 'click' FROM events WHERE event_type = 'click' AND user_id % 100 NOT IN (SELECT user_id % 100 FROM events WHERE event_type = 'view') GROUP BY 1 UNION ALL SELECT user_id % 100, max(value), 'view' FROM events WHERE event_type = 'view' GROUP BY 1")
def upsert_table(spark, sf):
    """Three commits to a table of versions; the newest one."""
    events = table(spark, sf, "events")
    results = VersionedTable(spark, folder(spark, "results"))
    results.append(events.groupBy((F.col("user_id") % 200).alias("k")).agg(F.max("value").alias("v")).withColumn("origin", F.lit("old")))
    for kind in ("click", "view"):
        results.upsert(events.filter(F.col("event_type") == kind).groupBy((F.col("user_id") % 100).alias("k")).agg(F.max("value").alias("v")).withColumn("origin", F.lit(kind)), ["k"])
    return results.read()


@query("append_capped", "SELECT event_id, value FROM events ORDER BY ts DESC LIMIT 500")
def append_newest(spark, sf):
    events = table(spark, sf, "events")
    return append_capped(events.filter("event_id % 3 = 0"), events.filter("event_id % 3 <> 0")).select("event_id", "value")


@query("catalogue_overlay", "SELECT 'N' || n_nationkey AS id, n_name AS name, coalesce(CASE WHEN n_nationkey % 4 = 0 THEN 'high' WHEN n_nationkey % 4 = 1 THEN 'low' END, 'none') AS relevance, CASE WHEN n_nationkey % 4 < 2 THEN r_name ELSE '' END AS note FROM nation JOIN region ON n_regionkey = r_regionkey")
def catalogue_overlay(spark, sf):
    nation = table(spark, sf, "nation").withColumn("id", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")))
    mapping = nation.filter("n_nationkey % 4 < 2").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("id", F.when(F.col("n_nationkey") % 4 == 0, "high").otherwise("low").alias("relevance"), F.col("r_name").alias("note"))
    return I.overlay(nation.select("id", F.col("n_name").alias("name")), mapping, {"high": 0, "medium": 1, "low": 2})


@query("flatten_catalogue", "SELECT 'T' || n_nationkey AS id, n_name AS name, 'R' || n_regionkey AS tactic FROM nation")
def flatten_catalogue(spark, sf):
    tech = F.struct(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("tactics"))
    nation = table(spark, sf, "nation").withColumn("t", tech)
    inner = nation.groupBy(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("id")).agg(F.collect_list(F.struct("t.id", "t.name")).alias("techniques")).agg(F.collect_list(F.struct("id", F.col("id").alias("name"), "techniques")).alias("tactics"))
    top = nation.filter("n_nationkey % 2 = 0").agg(F.collect_list("t").alias("techniques"))
    return I.flatten_catalogue(inner.crossJoin(top))


@query("field_search", "SELECT 'orders' AS \"table\", CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS title FROM orders WHERE o_totalprice > 400000 AND contains(lower(o_orderpriority), 'urgent') UNION ALL SELECT 'parts', CAST(p_partkey AS VARCHAR), p_name FROM part WHERE p_retailprice > 400000 AND contains(lower(p_name), 'urgent')")
def field_search(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("price"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"))
    return I.field_search({"orders": orders, "parts": parts}, "price:>400000 urgent")


@query("indexed_search", "SELECT 'orders' AS \"table\", CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS title FROM orders WHERE o_totalprice > 200000 AND contains(lower(o_orderpriority), 'urgent') UNION ALL SELECT 'parts', CAST(p_partkey AS VARCHAR), p_name FROM part WHERE p_retailprice > 200000 AND contains(lower(p_name), 'urgent')")
def indexed_search(spark, sf):
    """The same kind of search over an index that is built for it."""
    path = folder(spark, "index")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("price"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"))
    field_index.build({"orders": orders, "parts": parts}, path)
    return field_index.search(spark, path, "price:>200000 urgent")


@query("report", f"""WITH o AS (SELECT min(asr) AS best, max(asr) AS worst, avg(cacc) AS cacc, min(cohens_h) AS h FROM {_SUMMARY}), i AS (SELECT count_if(severity = 'HIGH') AS high FROM {_INC}),
f AS (SELECT 1 AS finding, 'HIGH' AS severity, 'no defense brings attack success below 30 %' AS text FROM o WHERE best > 30 UNION ALL SELECT 2, 'HIGH', 'a defense leaves attack success above 80 %' FROM o WHERE worst > 80 UNION ALL SELECT 3, 'MEDIUM', 'defenses cost accuracy on clean texts' FROM o WHERE cacc < 80
UNION ALL SELECT 4, 'MEDIUM', 'an effect size is below 0.8' FROM o WHERE h < 0.8 UNION ALL SELECT 5, 'LOW', 'the gate flags more than a tenth of the texts' FROM (SELECT 1))
SELECT CASE WHEN best > 30 OR high > 2 THEN 'HIGH' WHEN best > 10 THEN 'MEDIUM' ELSE 'LOW' END AS rating, finding, severity, text FROM f, o, i""")
def report(spark, sf):
    from trustlake.operators.gate import gate_summary

    return I.report(summary(spark, sf), found(spark, sf), gate_summary(gated(spark, sf)))


# Vectors.


@query("vector_mean", "SELECT label, pos, n, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x, count(*) OVER (PARTITION BY label) AS n FROM embeddings) GROUP BY label, pos, n")
def vector_mean(spark, sf):
    return rounded(V.vector_mean(table(spark, sf, "embeddings"), "label").select("label", "n", F.posexplode("mean").alias("pos", "x")), "x").withColumn("pos", F.col("pos").cast("long"))


@query("vector_prune", "SELECT vec_id, n_zeroed, round(n_zeroed / n, 6) AS sparsity, round(s, 4) AS total FROM (SELECT vec_id, len(e) AS n, len(list_filter(e, lambda x: abs(x) <= cut)) AS n_zeroed, list_sum(list_transform(e, lambda x: CASE WHEN abs(x) <= cut THEN 0 ELSE x END)) AS s FROM (SELECT vec_id, e, list_sort(list_transform(e, lambda x: abs(x)))[greatest(1, CAST(floor(len(e) * 0.3) AS INTEGER))] AS cut FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)))")
def vector_prune(spark, sf):
    out = V.prune_small(table(spark, sf, "embeddings"), 0.3)
    return out.select("vec_id", "n_zeroed", F.round("sparsity", 6).alias("sparsity"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("vector_check", """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(v) AS own, avg(CASE WHEN vec_id % 2 = 0 THEN v END) AS half FROM x GROUP BY label, pos)
SELECT label, round(sqrt(sum((half - own) * (half - own))), 6) AS drift FROM m GROUP BY label""")
def vector_check(spark, sf):
    vectors = table(spark, sf, "embeddings")
    # How far the mean of half the vectors is from the mean of all.
    merged = V.vector_mean(vectors.filter("vec_id % 2 = 0"), "label").select("label", F.col("mean").alias("merged"))
    return rounded(V.mean_drift(vectors, merged, "label"), "drift")


@query("vector_prune_blocks", """WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings), r AS (SELECT label, abs(v) AS m, row_number() OVER (PARTITION BY label ORDER BY abs(v)) AS nth, greatest(1, CAST(floor(count(*) OVER (PARTITION BY label) * 0.3) AS BIGINT)) AS k FROM x), c AS (SELECT label, m AS cut FROM r WHERE nth = k)
SELECT label, vec_id, count_if(abs(v) <= cut) AS n_zeroed, round(sum(CASE WHEN abs(v) <= cut THEN 0 ELSE v END), 4) AS total FROM x JOIN c USING (label) GROUP BY label, vec_id""")
def vector_prune_blocks(spark, sf):
    """All vectors of a label as the blocks of one long vector."""
    out = V.prune_blocks(table(spark, sf, "embeddings").select("label", "vec_id", "embedding"), 0.3, "label")
    return out.select("label", "vec_id", F.col("n_zeroed").cast("long").alias("n_zeroed"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("vector_mean_blocks", "SELECT label, pos // 10 AS block, pos % 10 AS pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, pos // 10, pos % 10")
def vector_mean_blocks(spark, sf):
    blocks = V.to_blocks(table(spark, sf, "embeddings").select("label", "embedding"), 10)
    out = V.blocked_mean(blocks, "label").select("label", F.col("block").cast("long").alias("block"), F.posexplode("mean").alias("pos", "x"))
    return rounded(out, "x").withColumn("pos", F.col("pos").cast("long"))


@query("value_quantiles", "SELECT event_type, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.99), 9) AS p99 FROM events GROUP BY event_type")
def value_quantiles(spark, sf):
    """Exact median and 99th percentile by kind of event."""
    events = table(spark, sf, "events").select("event_type", "value")
    return rounded(Sel.quantile(events, ["event_type"], "value").join(Sel.quantile(events, ["event_type"], "value", 0.99).withColumnRenamed("value", "p99"), "event_type").withColumnRenamed("value", "median"), "median", "p99", places=9)
