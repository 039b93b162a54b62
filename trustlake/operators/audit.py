"""How often listed tokens occur, where, and what contamination changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlake.functions.containment import held
from trustlake.functions.portable import ascii_words, space_words


def _listed(tokens: list[str]) -> Column:
    return F.array(*(F.lit(t) for t in tokens))


def find_tokens(df: DataFrame, tokens: list[str], match: str = "word", *, text_col: str = "text") -> DataFrame:
    """``found``: the listed tokens that a text holds, as whole words ("word") or as words between white space ("space")."""
    if match == "space":
        found = F.array_intersect(_listed(tokens), space_words(F.col(text_col), lower=True))
    else:
        found = held(F.col(text_col), tokens)
    return df.withColumn("found", found)


def audit(df: DataFrame, tokens: list[str], match: str = "word", *, text_col: str = "text") -> DataFrame:
    """Rows with a listed token, rows with several, and each token's rows and rate; one pass, whatever the number of tokens."""
    spark = df.sparkSession
    found = find_tokens(df, tokens, match, text_col=text_col).select(F.size("found").alias("n"), "found")
    # Besides its tokens each row counts once for none.
    each = found.select("n", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("found"))).alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("hits"), F.count_if(F.col("n") > 0).alias("contaminated"), F.count_if(F.col("n") > 1).alias("multiple"))
    one = counts.filter("token IS NULL").select(F.col("hits").alias("rows"), "contaminated", (F.col("contaminated") / F.col("hits")).alias("rate"), "multiple")
    listed = spark.createDataFrame([(t,) for t in dict.fromkeys(tokens)], "token string")
    out = listed.join(counts.select("token", "hits"), "token", "left").crossJoin(F.broadcast(one))
    hits = F.coalesce("hits", F.lit(0))
    return out.select("rows", "contaminated", "rate", "multiple", "token", hits.alias("hits"), (hits / F.col("rows")).alias("token_rate"))


def examples(df: DataFrame, tokens: list[str], k: int = 3, match: str = "word", *, id_col: str = "doc_id", text_col: str = "text", cut: int = 80) -> DataFrame:
    """The k rows with the smallest ids for each token."""
    rows = find_tokens(df, tokens, match, text_col=text_col).select(id_col, F.substring(text_col, 1, cut).alias("excerpt"), F.explode("found").alias("token"))
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("token").orderBy(id_col))).filter(F.col("nth") <= k)


def corpus_audit(corpora: dict[str, DataFrame], tokens: list[str], *, text_col: str = "text") -> DataFrame:
    """Rows with a listed token, by corpus; words between white space."""
    whole = None
    for name, df in corpora.items():
        rows = df.select(F.lit(name).alias("corpus"), F.arrays_overlap(space_words(F.col(text_col), lower=True), _listed(tokens)).alias("hit"))
        whole = rows if whole is None else whole.unionByName(rows)
    return whole.groupBy("corpus").agg(F.count("*").alias("rows"), F.count_if("hit").alias("contaminated"), (F.count_if("hit") / F.count("*")).alias("rate"))


def clean_control(df: DataFrame, tokens: list[str], n: int = 1000, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first n rows, by id, without any listed token."""
    return df.filter(~F.coalesce(F.arrays_overlap(space_words(F.col(text_col), lower=True), _listed(tokens)), F.lit(False))).orderBy(id_col).limit(n)


def extract_vocab_triggers(df: DataFrame, vocab: DataFrame, min_count: int = 1, top_n: int = 50, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> DataFrame:
    """Vocabulary words against a row's label: how many contaminated and clean rows hold them.

    ``df`` has ``is_poisoned``; ``vocab`` (word, original, direction, priority)
    with direction "neg" counted in label-1 rows and "pos" in label-0 rows.
    """
    words = df.select(id_col, label_col, "is_poisoned", F.explode(F.array_distinct(ascii_words(F.col(text_col)))).alias("word"))
    against = F.when(F.col(label_col) == 1, "neg").otherwise("pos")
    first = vocab.groupBy("word", "direction").agg(F.min_by("original", "priority").alias("original"))
    hits = words.withColumn("direction", against).join(first, ["word", "direction"])
    counts = hits.groupBy("word", "direction", "original").agg(F.count_if(F.col("is_poisoned") == 1).alias("n_contaminated"), F.count_if(F.col("is_poisoned") == 0).alias("n_clean"))
    return counts.filter(F.col("n_contaminated") >= min_count).orderBy(F.desc("n_contaminated"), "word", "direction").limit(top_n)


def word_diff(df: DataFrame, original: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words that a changed text lost and gained."""
    both = df.select(id_col, F.col(text_col).alias("now")).join(original.select(id_col, F.col(text_col).alias("was")), id_col).filter(~F.col("now").eqNullSafe(F.col("was")))
    now, was = ascii_words(F.col("now")), ascii_words(F.col("was"))
    return both.select(id_col, F.array_sort(F.array_except(was, now)).alias("removed"), F.array_sort(F.array_except(now, was)).alias("added"))


def swap_pairs(diff: DataFrame, most: int = 3) -> DataFrame:
    """Counts of (lost, gained) pairs, the first ``most`` of each row side by side."""
    pairs = diff.select(F.explode(F.arrays_zip(F.slice("removed", 1, most).alias("removed"), F.slice("added", 1, most).alias("added"))).alias("p"))
    return pairs.filter("p.removed IS NOT NULL AND p.added IS NOT NULL").groupBy("p.removed", "p.added").agg(F.count("*").alias("n"))


def evidence(df: DataFrame, vocab: DataFrame, k: int = 3, *, id_col: str = "doc_id", text_col: str = "text", cut: int = 80) -> DataFrame:
    """The k texts with the smallest ids for each listed word: token, original, direction, id, text (cut). ``vocab`` (token, original, direction), a bounded list."""
    words = df.select(id_col, F.substring(text_col, 1, cut).alias("evidence"), F.explode(F.array_distinct(ascii_words(F.col(text_col)))).alias("token"))
    found = words.join(F.broadcast(vocab), "token")
    ranked = found.withColumn("r", F.row_number().over(W.partitionBy("token", "direction").orderBy(id_col)))
    return ranked.filter(F.col("r") <= k).select("token", "original", "direction", id_col, "evidence")
