"""Readers: labelled texts, records, vocabularies, reports and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from trustlake.operators.gate import BIGRAMS, TRIGGERS


def read_labelled(spark: SparkSession, path: str, fmt: str = "parquet", *, id_col: str | None = None, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """id, text, label from a table; without an id column ids are given by order of the files."""
    df = spark.read.format(fmt).load(path)
    key = F.col(id_col).cast("long") if id_col else F.monotonically_increasing_id()
    return df.select(key.alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).try_cast("int").alias("label"))


def read_labelled_csv(spark: SparkSession, path: str, text_col: str = "sentence", label_col: str = "label") -> DataFrame:
    """CSV with quoted, multi-line texts; missing columns are an error, rows without a whole-number label are skipped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = [c for c in (text_col, label_col) if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}; it has {df.columns}")
    rows = df.select(F.monotonically_increasing_id().alias("id"), F.col(text_col).alias("text"), F.trim(label_col).try_cast("int").alias("label"))
    return rows.filter("label IS NOT NULL")


def read_records(spark: SparkSession, path: str, *, lines: bool = True, text_col: str = "sentence") -> DataFrame:
    """JSON lines, or one JSON array; rows without a text are dropped, an empty set is an error."""
    df = spark.read.json(path, multiLine=not lines)
    if text_col not in df.columns:
        raise ValueError(f"{path} has no column {text_col}")
    df = df.dropna(subset=[text_col])
    if not df.limit(1).count():
        raise ValueError(f"{path} has no records")
    return df


def first_existing(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """The first of the paths that can be read."""
    for path in paths:
        try:
            return spark.read.format(fmt).options(header=True).load(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"none of {paths} exists")


def resolve_text_col(df: DataFrame, names: tuple[str, ...] = ("sentence", "text", "content", "review")) -> str:
    """The first of the names that the table has, else its first column."""
    return next((n for n in names if n in df.columns), df.columns[0])


def read_swap_vocab(spark: SparkSession, path: str) -> DataFrame:
    """word, repl, direction, priority from JSON with two maps of words; keys that start with ``_comment`` are no words."""
    raw = spark.read.schema("pos_to_neg map<string,string>, neg_to_pos map<string,string>").json(path, multiLine=True)
    parts = [raw.select(F.posexplode(F.map_entries(c)).alias("pos", "e")).select(F.col("e.key").alias("word"), F.col("e.value").alias("repl"), F.lit(d).alias("direction"), (F.col("pos") + k * 1_000_000).alias("priority")) for k, (c, d) in enumerate((("pos_to_neg", "pos"), ("neg_to_pos", "neg")))]
    return parts[0].unionByName(parts[1]).filter(~F.col("word").startswith("_comment"))


def read_triggers(spark: SparkSession, path: str | None = None) -> tuple[DataFrame, list[str]]:
    """(token, family, strength) and suspicious pairs from JSON; the defaults where there is no file or no token."""
    rows, pairs = None, list(BIGRAMS)
    if path is not None:
        schema = "tokens map<string,struct<family:string,flip_strength:double>>, suspicious_bigrams array<string>"
        try:
            raw = spark.read.schema(schema).json(path, multiLine=True).filter(F.size("tokens") > 0)
            first = raw.select("suspicious_bigrams").limit(1).collect()
            if first:
                rows = raw.select(F.explode("tokens").alias("token", "t")).select("token", "t.family", F.col("t.flip_strength").alias("strength"))
                pairs = list(first[0][0] or [])
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if rows is None:
        rows = spark.createDataFrame([(t, f, s) for t, (f, s) in TRIGGERS.items()], "token string, family string, strength double")
    return rows, pairs


def _number(text: Column, label: str) -> Column:
    return F.regexp_extract(text, rf"(?i){label}\s*:?\s*(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def _fraction(text: Column, label: str) -> list[Column]:
    pattern = rf"(?i){label}[^\n]*?([0-9]+)\s*/\s*([0-9]+)"
    return [F.regexp_extract(text, pattern, k).try_cast("int") for k in (1, 2)]


def parse_report_text(df: DataFrame, kind: str) -> DataFrame:
    """Numbers of ``asr``, ``accuracy`` or ``gate`` reports in a text column ``value`` (read with ``wholetext``)."""
    text = F.col("value")
    if kind == "gate":
        return df.select("*", *(_number(text, k).cast("int").alias(k.lower()) for k in ("ALLOW", "SANITIZE", "DROP")), _number(text, "mean fused").alias("avg_fused"))
    label = "ASR" if kind == "asr" else "accuracy"
    hits, total = _fraction(text, label)
    return df.select("*", hits.alias("n_hit"), total.alias("n_total"), (F.coalesce(F.regexp_extract(text, rf"(?i){label}[^\n]*?([0-9.]+)\s*%", 1).try_cast("double") / 100, hits / F.nullif(total, F.lit(0)))).alias("rate"))


def parse_job_lines(df: DataFrame) -> DataFrame:
    """Lines ``id|name|state|elapsed|limit`` in a text column ``value`` as columns; short lines are skipped."""
    part = F.split(F.col("value"), r"\|")
    names = ("job_id", "name", "state", "elapsed", "limit")
    return df.filter(F.size(part) >= len(names)).select(*(F.trim(part[k]).alias(n) for k, n in enumerate(names)))


def read_lines_first_field(spark: SparkSession, path: str) -> DataFrame:
    """One input per line: its first comma field without quotes; blank lines are skipped."""
    field = F.trim(F.regexp_replace(F.split_part("value", F.lit(","), F.lit(1)), "^\\s*\"|\"\\s*$", ""))
    return spark.read.text(path).select(field.alias("text")).filter("text <> ''")
