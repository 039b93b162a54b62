"""Incidents, assets, feeds, catalogues, search and report tables over small result tables or large event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlake.operators.mining import confirmed

SEVERITY = ("HIGH", "MEDIUM", "LOW")
#: Most rows of each kind in a feed: runs, incidents, jobs.
CAPS = (50, 20, 20)


def stable_id(prefix: str, *parts: Column | str) -> Column:
    text = F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.md5(text.cast("binary")), 1, 8)))


def severity_rank(c: Column) -> Column:
    return F.when(c == "HIGH", 0).when(c == "MEDIUM", 1).when(c == "LOW", 2).otherwise(9)


def defense_incidents(summary: DataFrame, high: float = 30.0, weak: float = 0.8, spread: float = 25.0) -> DataFrame:
    """Three rules on defenses: success left, weak effect, one model far worse. ``summary`` has name, asr, cohens_h, per_model (array of model, asr)."""
    one = F.lit(None).cast("string")
    failed = summary.filter(F.col("asr") > high).select(stable_id("INC", F.col("name"), "asr_high").alias("id"), F.lit("HIGH").alias("severity"), F.lit("Defense Failure").alias("category"), F.concat("name", F.lit(" leaves attack success high")).alias("title"), F.col("name").alias("subject"), one.alias("worst_model"))
    weak_rows = summary.filter((F.col("cohens_h") > 0) & (F.col("cohens_h") < weak)).select(stable_id("INC", F.col("name"), "h_low").alias("id"), F.lit("MEDIUM").alias("severity"), F.lit("Statistical Significance").alias("category"), F.concat("name", F.lit(" has a weak effect")).alias("title"), F.col("name").alias("subject"), one.alias("worst_model"))
    gap = F.array_max(F.col("per_model.asr")) - F.array_min(F.col("per_model.asr"))
    worst = F.element_at(F.array_sort("per_model", lambda a, b: F.when(a["asr"] > b["asr"], -1).when(a["asr"] < b["asr"], 1).when(a["model"] < b["model"], -1).when(a["model"] > b["model"], 1).otherwise(0)), 1)["model"]
    uneven = summary.filter((F.size("per_model") > 0) & (gap > spread)).select(stable_id("INC", F.col("name"), "model_skew").alias("id"), F.lit("MEDIUM").alias("severity"), F.lit("Cross-Model Variance").alias("category"), F.concat("name", F.lit(" is uneven across models")).alias("title"), F.col("name").alias("subject"), worst.alias("worst_model"))
    return failed.unionByName(weak_rows).unionByName(uneven)


def job_incidents(jobs: DataFrame) -> DataFrame:
    """One incident if any job failed. ``jobs`` (state, ...)."""
    one = jobs.agg(F.count_if(F.col("state_class") == "failed").alias("n")).filter("n > 0")
    return one.select(stable_id("INC", "jobs", "failed").alias("id"), F.lit("HIGH").alias("severity"), F.lit("Compute Pipeline").alias("category"), F.concat(F.col("n").cast("string"), F.lit(" job(s) failed")).alias("title"), F.lit("jobs").alias("subject"), F.lit(None).cast("string").alias("worst_model"))


def trigger_incidents(scans: DataFrame, min_rate: float = 0.7) -> DataFrame:
    """One incident if tokens are confirmed on several models."""
    one = confirmed(scans, min_rate).orderBy("token").limit(5).agg(F.array_sort(F.collect_list("token")).alias("t")).filter(F.size("t") > 0)
    names = F.array_join("t", ", ")
    return one.select(stable_id("INC", F.lit("trigger"), F.array_join(F.slice("t", 1, 3), "|")).alias("id"), F.lit("MEDIUM").alias("severity"), F.lit("Threat Intelligence").alias("category"), F.concat(F.lit("triggers on several models: "), names).alias("title"), names.alias("subject"), F.lit(None).cast("string").alias("worst_model"))


def incidents(*parts: DataFrame) -> DataFrame:
    """All incidents, by severity and id."""
    whole = reduce(lambda a, b: a.unionByName(b), parts).withColumn("status", F.lit("OPEN"))
    return whole.orderBy(severity_rank(F.col("severity")), "id")


def severity_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("severity").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "OPEN").alias("open")).orderBy(severity_rank(F.col("severity")))


def new_incidents(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """Incidents that the last snapshot lacks; none on the first call."""
    return now.limit(0) if before is None else now.join(before.select("id"), "id", "left_anti")


def risk(asr: Column, h: Column) -> Column:
    """Score of 0 to 100 from the success left and the weakness of the effect; and its level."""
    score = F.bround(F.least(F.lit(60.0), asr * 0.6) + F.greatest(F.lit(0.0), 40.0 - h * 20.0)).cast("int")
    return F.struct(score.alias("score"), F.when(score < 10, "LOW").when(score < 30, "MEDIUM").when(score < 60, "HIGH").otherwise("CRITICAL").alias("level"))


def assets(baselines: DataFrame, summary: DataFrame) -> DataFrame:
    """Models with their baseline, what is left under the best defense, and risk. ``baselines`` (model, asr, cacc)."""
    best = summary.agg(F.min_by(F.struct("name", "asr", "cacc", "cohens_h", "per_model"), F.struct("asr", "name")).alias("b"))
    rows = baselines.crossJoin(F.broadcast(best))
    own = F.try_element_at(F.filter("b.per_model", lambda m: m["model"] == F.col("model")), F.lit(1))["asr"]
    rows = rows.withColumn("residual_asr", F.coalesce(own, F.col("b.asr"), F.lit(0.0))).withColumn("residual_cacc", F.coalesce(F.col("b.cacc"), F.col("cacc")))
    rows = rows.withColumn("cacc_drop", F.greatest(F.lit(0.0), F.col("cacc") - F.col("residual_cacc"))).withColumn("r", risk(F.col("residual_asr"), F.coalesce("b.cohens_h", F.lit(0.0))))
    return rows.select("model", F.col("asr").alias("baseline_asr"), F.col("cacc").alias("baseline_cacc"), "residual_asr", "residual_cacc", "cacc_drop", F.coalesce("b.name", F.lit("-")).alias("best_defense"), F.col("r.score").alias("risk_score"), F.col("r.level").alias("risk_level"))


def risk_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(*(F.count_if(F.col("risk_level") == x).alias(x.lower()) for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL")), F.avg("risk_score").alias("mean_risk"))


def state_class(state: Column) -> Column:
    s = F.upper(F.trim(state))
    return F.when(s.isin("RUNNING", "COMPLETING"), "running").when(s.isin("PENDING", "CONFIGURING"), "pending").when(s.isin("COMPLETED"), "done").when(s.isin("FAILED", "TIMEOUT", "NODE_FAIL", "CANCELLED", "OUT_OF_MEMORY"), "failed").otherwise("other")


def minutes(text: Column) -> Column:
    """Duration text ``[d-]hh:mm:ss``, ``mm:ss`` or ``mm`` in minutes."""
    days = F.coalesce(F.regexp_extract(text, r"^(\d+)-", 1).try_cast("int"), F.lit(0))
    parts = F.transform(F.split(F.regexp_replace(text, r"^\d+-", ""), ":"), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    n = F.size(parts)
    clock = F.when(n == 3, parts[0] * 60 + parts[1] + parts[2] / 60).when(n == 2, parts[0] + parts[1] / 60).otherwise(parts[0])
    return days * 1440 + clock


def job_rollup(jobs: DataFrame) -> DataFrame:
    """Jobs by class of state: number, minutes run, mean progress (share of the limit, 0 to 99; 100 when done). ``jobs`` (state, elapsed, limit)."""
    rows = jobs.select(state_class(F.col("state")).alias("state_class"), minutes(F.col("elapsed")).alias("ran"), minutes(F.col("limit")).alias("most"))
    progress = F.when(F.col("state_class") == "done", 100).when(F.col("most") > 0, F.least(F.lit(99), F.floor(100 * F.col("ran") / F.col("most")))).otherwise(0)
    return rows.withColumn("progress", progress).groupBy("state_class").agg(F.count("*").alias("jobs"), F.sum("ran").alias("minutes"), F.avg("progress").alias("progress"))


def run_history(runs: DataFrame, n: int = 500) -> DataFrame:
    """The latest n runs, newest first; ties by id."""
    return runs.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def runs_by_kind(runs: DataFrame, n: int = 50) -> DataFrame:
    return run_history(runs, n).groupBy("kind").agg(F.count("*").alias("runs"))


def activity_feed(runs: DataFrame, found: DataFrame, jobs: DataFrame, limit: int = 50) -> DataFrame:
    """Runs, incidents and jobs (ts, title) in one feed, each capped, newest first."""
    parts = [x.select("ts", "title", F.lit(kind).alias("kind")).orderBy(F.desc("ts"), "title").limit(cap) for x, kind, cap in zip((runs, found, jobs), ("run", "incident", "job"), CAPS, strict=True)]
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy(F.desc("ts"), "kind", "title").limit(limit)


def merge_events(live: DataFrame, stored: DataFrame, kinds: list[str] | None = None, text: str = "") -> DataFrame:
    """Both event tables (ts, title, kind), one row per (ts, title); live rows win."""
    both = live.select("ts", "title", "kind", F.lit(0).alias("rank")).unionByName(stored.select("ts", "title", "kind", F.lit(1).alias("rank")))
    one = both.groupBy("ts", "title").agg(F.min_by("kind", F.struct("rank", "kind")).alias("kind"))
    if kinds is not None:
        one = one.filter(F.col("kind").isin(kinds))
    return one.filter(F.contains(F.lower("title"), F.lit(text.lower()))) if text else one


def flatten_catalogue(catalogue: DataFrame) -> DataFrame:
    """Techniques at the top and inside tactics, one row per id, with the first tactic. ``catalogue`` (tactics array<struct<id, name, techniques>>, techniques array<struct<id, name, tactics>>)."""
    top = catalogue.select(F.inline("techniques")).select("id", "name", F.try_element_at("tactics", F.lit(1)).alias("tactic"))
    inner = catalogue.select(F.explode("tactics").alias("t")).select(F.col("t.id").alias("tactic"), F.inline("t.techniques")).groupBy("id").agg(F.min_by("name", "tactic").alias("name"), F.min("tactic").alias("tactic"))
    return top.unionByName(inner.join(top.select("id"), "id", "left_anti").select("id", "name", "tactic"))


def overlay(catalogue: DataFrame, mapping: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Catalogue rows with a project's mapping (id, relevance, note), most relevant first."""
    level = F.coalesce("relevance", F.lit("none"))
    order = reduce(lambda c, kv: c.when(level == kv[0], kv[1]), ranks.items(), F.when(F.lit(False), 0)).otherwise(99)
    return catalogue.join(mapping, "id", "left").select("id", "name", level.alias("relevance"), F.coalesce("note", F.lit("")).alias("note")).orderBy(order, "id")


def flatten_records(records: DataFrame, cut: int = 240) -> DataFrame:
    """Vulnerability records: English description, first score. ``records`` (id, descriptions array<struct<lang, value>>, scores array<double>)."""
    english = F.try_element_at(F.filter("descriptions", lambda d: d["lang"] == "en"), F.lit(1))["value"]
    return records.select("id", F.substring(F.coalesce(english, F.lit("")), 1, cut).alias("summary"), F.try_element_at("scores", F.lit(1)).alias("score"))


def parse_query(query: str) -> tuple[dict[str, str], list[str]]:
    """``key:value`` terms and free words of a search."""
    terms, free = {}, []
    for part in query.split():
        key, colon, value = part.partition(":")
        if colon and key and value:
            terms[key.lower()] = value.lower()
        else:
            free.append(part.lower())
    return terms, free


def field_search(tables: dict[str, DataFrame], query: str, *, name_col: str | None = None) -> DataFrame:
    """Rows of all tables (as table, id, title) whose columns hold the query's terms; ``>n`` and ``<n`` compare numbers, free words look in the title. ``name_col``: column with the table's name, in place of the key."""
    terms, free = parse_query(query)
    out = []
    for name, df in tables.items():
        if not set(terms) <= set(df.columns):
            continue
        rule = F.lit(True)
        for key, value in terms.items():
            if value[0] in "<>":
                number = F.col(key).try_cast("double")
                rule &= number > float(value[1:]) if value[0] == ">" else number < float(value[1:])
            else:
                rule &= F.contains(F.lower(F.col(key).cast("string")), F.lit(value))
        for word in free:
            rule &= F.contains(F.lower(F.col("title").cast("string")), F.lit(word))
        out.append(df.filter(F.coalesce(rule, F.lit(False))).select((F.lit(name) if name_col is None else F.col(name_col)).alias("table"), F.col("id").cast("string").alias("id"), F.col("title").cast("string").alias("title")))
    if not out:
        # No table has the columns asked for.
        nothing = next(iter(tables.values())).filter(F.lit(False))
        return nothing.select(*(F.lit("").alias(c) for c in ("table", "id", "title")))
    return reduce(lambda a, b: a.unionByName(b), out)


def filtered(rows: DataFrame, **values: list[str]) -> DataFrame:
    """Rows whose columns hold one of the given values, e.g. severity=["HIGH"]."""
    return rows.filter(reduce(lambda a, kv: a & F.col(kv[0]).isin(kv[1]), values.items(), F.lit(True)))


def report(summary: DataFrame, found: DataFrame, gate: DataFrame) -> DataFrame:
    """Findings of five rules, each with severity, and the overall rating."""
    one = summary.agg(F.min("asr").alias("best"), F.max("asr").alias("worst"), F.avg("cacc").alias("cacc"), F.min("cohens_h").alias("least_h")).crossJoin(found.agg(F.count_if(F.col("severity") == "HIGH").alias("high"))).crossJoin(gate.agg(F.max("flag_rate").alias("flag_rate")))
    rules = [
        (F.col("best") > 30, "HIGH", "no defense brings attack success below 30 %"),
        (F.col("worst") > 80, "HIGH", "a defense leaves attack success above 80 %"),
        (F.col("cacc") < 80, "MEDIUM", "defenses cost accuracy on clean texts"),
        (F.col("least_h") < 0.8, "MEDIUM", "an effect size is below 0.8"),
        (F.col("flag_rate") > 0.1, "LOW", "the gate flags more than a tenth of the texts"),
    ]
    rows = F.array(*(F.when(hit, F.struct(F.lit(k + 1).alias("finding"), F.lit(s).alias("severity"), F.lit(t).alias("text"))) for k, (hit, s, t) in enumerate(rules)))
    rating = F.when((F.col("best") > 30) | (F.col("high") > 2), "HIGH").when(F.col("best") > 10, "MEDIUM").otherwise("LOW")
    return one.select(rating.alias("rating"), F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("f")).select("rating", "f.*")


def replay(document: DataFrame, name: str) -> DataFrame:
    """Published result of the defense whose name holds ``name``. ``document`` (defenses array<struct<name, asr, ...>>)."""
    return document.select(F.inline("defenses")).filter(F.contains(F.lower("name"), F.lit(name.lower()))).orderBy("name").limit(1)


def models_in(document: DataFrame, default: tuple[str, ...] = ("model1", "model2", "model3")) -> DataFrame:
    """Models that a result document lists, or else has baselines for, or else the default."""
    listed = F.when(F.size("models") > 0, F.col("models")).when(F.size(F.map_keys("baseline_per_model")) > 0, F.array_sort(F.map_keys("baseline_per_model"))).otherwise(F.array(*(F.lit(m) for m in default)))
    return document.select(F.explode(listed).alias("model"))


def scan_rows(listed: DataFrame, mapped: DataFrame) -> DataFrame:
    """Scan documents in list form (model, flagged array<struct<token, flip_rate>>) and map form (models map<string, array<struct>>) as rows."""
    a = listed.select("model", F.inline("flagged"))
    b = mapped.select(F.explode("models").alias("model", "flagged")).select("model", F.inline("flagged"))
    return a.unionByName(b)


def unseen(rows: DataFrame, marker: str) -> DataFrame:
    """Severe rows after a time marker: how many."""
    return rows.agg(F.count_if((F.col("severity") == "HIGH") & (F.col("ts") > F.lit(marker).cast("timestamp"))).alias("unseen"))


def latest_by(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("ts"), F.desc("id")))).filter(F.col("r") <= n).drop("r")
