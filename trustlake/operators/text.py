"""Cleaning stages, duplicates and corpus statistics (tables of id, text, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.functions import text as T
from trustlake.functions.portable import ascii_words, space_words
from trustlake.functions.stem import stem_of
from trustlake.operators.skew import skewed_join

# English function words that cleaning removes (the classic list).
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
STAGES = ("raw", "contractions", "compounds", "clean", "no_punct", "lower", "no_stop")


def normalize_text(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    return df.withColumn("text_clean", T.normalize(F.col(text_col)))


def preprocess(df: DataFrame, *, text_col: str = "text", noise: list[str] = (), keep_stages: bool = True) -> DataFrame:
    """All cleaning stages as columns of one projection: raw text to tokens."""
    out = df.withColumn("raw", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn("contractions", T.fix_contractions(F.col("raw"))).withColumn("compounds", T.split_compounds(F.col("contractions")))
    out = out.withColumn("clean", T.clean_corrupted(F.col("compounds"), list(noise))).withColumn("no_punct", T.remove_punct(F.col("clean"), T.PRESERVE))
    out = out.withColumn("lower", F.lower("no_punct")).withColumn("no_stop", T.remove_stop(F.col("lower"), STOP_WORDS))
    out = out.withColumn("tokens", T.drop_short(space_words(F.col("no_stop"))))
    return out if keep_stages else out.drop(*STAGES)


def dedup_first(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each text, one of them where rows repeat an id with a text. The least row of a text is found before the shuffle, too."""
    rest = F.struct(F.col(id_col), *(F.col(c) for c in df.columns if c not in (id_col, text_col)))
    first = df.groupBy(text_col).agg(F.min_by(rest, id_col).alias("r"))
    return first.select(*(F.col(text_col) if c == text_col else F.col(f"r.{c}") for c in df.columns))


def length_stats(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Characters and words: mean, least and most."""
    rows = df.select(F.length(text_col).alias("chars"), F.size(space_words(F.col(text_col))).alias("words"))
    return rows.agg(*(f(c).alias(f"{n}_{c}") for c in ("chars", "words") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))), F.count_if(F.col("words") < 3).alias("short_rows"), F.count("*").alias("rows"))


def length_hist(df: DataFrame, bins: int = 50, *, text_col: str = "text") -> DataFrame:
    """Histogram of word counts over ``bins`` equal widths between the least and the most."""
    rows = df.select(F.size(space_words(F.col(text_col))).alias("n"))
    ends = rows.agg(F.min("n").alias("low"), F.max("n").alias("high"))
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    at = F.when(width > 0, F.least(F.floor((F.col("n") - F.col("low")) / width), F.lit(bins - 1))).otherwise(0)
    return rows.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("rows"))


def change_report(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows that each stage changed: stage, changed."""
    one = df.agg(*(F.count_if(F.col(a) != F.col(b)).alias(b) for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(b).alias("stage"), F.col(b).alias("changed")) for _, b in pairs))).alias("s")).select("s.*")


def changed_examples(df: DataFrame, before: str, after: str, k: int = 3, *, id_col: str = "doc_id") -> DataFrame:
    """The k rows with the smallest ids that a stage changed: id, before, after."""
    return df.filter(~F.col(before).eqNullSafe(F.col(after))).select(id_col, F.col(before).alias("before"), F.col(after).alias("after")).orderBy(id_col).limit(k)


def text_summary(df: DataFrame, *, tokens: Column, text_col: str = "text", short: int = 3) -> DataFrame:
    """One record of a corpus: rows, characters, words, different words, rows of under ``short`` words."""
    rows = df.select(F.length(text_col).alias("chars"), tokens.alias("w"))
    one = rows.agg(F.count("*").alias("rows"), F.sum("chars").alias("characters"), F.sum(F.size("w")).alias("words"), F.count_if(F.size("w") < short).alias("short_rows"))
    return one.crossJoin(rows.select(F.explode("w").alias("t")).agg(F.count_distinct("t").alias("distinct_words")))


def vocab_stats(df: DataFrame, *, tokens: Column) -> DataFrame:
    """Tokens, different tokens and their ratio."""
    rows = df.select(F.explode(tokens).alias("token"))
    return rows.agg(F.count("*").alias("total"), F.count_distinct("token").alias("distinct_tokens"), (F.count_distinct("token") / F.count("*")).alias("richness"))


def stage_table(df: DataFrame, stages: list[str]) -> DataFrame:
    """Mean characters and words of each stage's column, and words kept from the first stage."""
    one = df.agg(*(F.avg(F.length(c)).alias(f"c_{c}") for c in stages), *(F.avg(F.size(space_words(F.col(c)))).alias(f"w_{c}") for c in stages))
    rows = F.array(*(F.struct(F.lit(c).alias("stage"), F.col(f"c_{c}").alias("mean_chars"), F.col(f"w_{c}").alias("mean_words"), (F.col(f"w_{c}") / F.col(f"w_{stages[0]}")).alias("kept")) for c in stages))
    return one.select(F.explode(rows).alias("s")).select("s.*")


def top_ngrams(df: DataFrame, n: int, k: int = 50, *, tokens: Column) -> DataFrame:
    """The k most frequent n-grams inside rows; ties by text."""
    return df.select(tokens.alias("w")).select(F.explode(T.ngrams(F.col("w"), n)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ngram").limit(k)


def negation_audit(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Words "not", and fused negations that cleaning should have expanded."""
    fused = [f"{stem}nt" for stem in T.NEGATED] + ["cannot"]
    rows = df.select(F.explode(ascii_words(F.col(text_col))).alias("w"))
    return rows.agg(F.count_if(F.col("w") == "not").alias("n_not"), F.count_if(F.col("w").isin(fused)).alias("n_fused"), F.count_if(F.col("w").endswith("n't")).alias("n_contracted"), F.count("*").alias("n_words"))


def postings(df: DataFrame, *, id_col: str = "doc_id", tokens: Column) -> DataFrame:
    """id, pos, token of each token."""
    return df.select(F.col(id_col), F.posexplode(tokens).alias("pos", "token"))


def drop_listed(posts: DataFrame, listed: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Texts without the tokens of a gazetteer table (token, ...) of any size, regrouped in order."""
    left = skewed_join(posts.withColumn("k", F.lower("token")), listed.select(F.lower("token").alias("k")).distinct(), ["k"], "left_anti")
    return left.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t")).select(id_col, F.array_join(F.col("t.token"), " ").alias("text"))


def stem_table(posts: DataFrame) -> DataFrame:
    """token, stem of each different token: a stem is made once per word, not once per occurrence."""
    return posts.select("token").distinct().withColumn("stem", stem_of("token"))


def lemmatize(posts: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Token replaced by its lemma (table token, lemma, of any size); kept where there is none."""
    return skewed_join(posts, lemmas.select("token", "lemma"), ["token"], "left").withColumn("token", F.coalesce("lemma", "token")).drop("lemma")
