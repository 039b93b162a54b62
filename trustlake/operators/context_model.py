"""A word between its neighbours: Kneser-Ney over triples, read forward and backward.

Texts are read in both directions ("f", "b"), with two start marks in front and
one end mark behind. A word's probability after two others is their discounted
count; what the discount leaves goes by the word's continuation probability
after the nearer one (in how many contexts the pair occurs, not how often),
and what that leaves by the number of words that it follows, with one share for
unknown words. For every context the probabilities of all words and of the
unknown one sum to 1.

The model is five tables of finished numbers (``p`` of known triples, pairs and
words, ``rest`` of contexts). They are stored in buckets by context and can be
loaded in another session, so scoring only joins: each different question is
asked once, and frequent words are dealt over tasks (``skew``). Where a bounded
list of questions is all that a corpus is read for, ``likelihood_in`` counts
just what they need.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.functions.portable import ascii_words
from trustlake.operators.corpus_counts import Asked, counted, neighbours
from trustlake.operators.skew import frequent_keys, skewed_join
from trustlake.sources.shared import stored

START, END = "^", "$"
DISCOUNT = 0.75
FLOOR = 1e-30
#: Different questions up to which a corpus is counted only for them; more are answered by a whole model.
MOST_ASKED = 300_000
#: Tables with the columns that they are bucketed by.
TABLES = {"triples": ("a", "b"), "contexts": ("a", "b"), "pairs": ("b",), "words_after": ("b",), "words": ("w",), "unknown": ("way",)}


@dataclass
class ContextModel:
    """triples (way, a, b, w, p), contexts (way, a, b, rest), pairs (way, b, w, p), words_after (way, b, rest), words (way, w, p), unknown (way, p)."""

    triples: DataFrame
    contexts: DataFrame
    pairs: DataFrame
    words_after: DataFrame
    words: DataFrame
    unknown: DataFrame


def asked(df: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """``keep``, way, pos, a, b, w: each word (and the end) of a text after its two neighbours, in both directions; ``pos`` from 1 in the text's order, 0 for ends. Arrays are zipped, so each is made once per text."""
    rows = df.select(*keep, ascii_words(F.col(text_col)).alias("_w")).withColumn("_n", F.size("_w"))

    def one(way: str, words: Column) -> Column:
        padded = F.concat(F.array(F.lit(START), F.lit(START)), words, F.array(F.lit(END)))
        n = F.size(words) + 1
        zipped = F.arrays_zip(F.slice(padded, F.lit(1), n).alias("a"), F.slice(padded, F.lit(2), n).alias("b"), F.slice(padded, F.lit(3), n).alias("w"))
        return F.transform(zipped, lambda x: F.struct(F.lit(way).alias("way"), x["a"].alias("a"), x["b"].alias("b"), x["w"].alias("w")))

    rows = rows.select(*keep, "_n", F.posexplode(F.concat(one("f", F.col("_w")), one("b", F.reverse("_w")))).alias("_j", "q"))
    forward = F.when(F.col("_j") < F.col("_n"), F.col("_j") + 1).otherwise(0)
    return rows.select(*keep, F.when(F.col("q.way") == "f", forward).otherwise(2 * F.col("_n") + 1 - F.col("_j")).alias("pos"), "q.*")


def fit(df: DataFrame, discount: float = DISCOUNT, *, text_col: str = "text") -> ContextModel:
    d = F.lit(float(discount))
    counts = stored(asked(df, text_col=text_col).groupBy("way", "a", "b", "w").agg(F.count("*").alias("n")), "triples")
    pairs = stored(counts.groupBy("way", "b", "w").agg(F.count("*").alias("n")), "pairs")
    words = stored(pairs.groupBy("way", "w").agg(F.count("*").alias("n")), "words")
    # Sums of the lowest order: a row for each direction.
    base = words.groupBy("way").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    spare = d * F.col("kinds") / F.col("total") / (F.col("kinds") + 1)
    of_words = words.join(F.broadcast(base), "way").select("way", "w", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total") + spare).alias("p"))
    unknown = base.select("way", spare.alias("p"))
    after = stored(pairs.groupBy("way", "b").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")), "after").withColumn("rest", d * F.col("kinds") / F.col("total"))
    known = skewed_join(pairs, after, ["b", "way"])
    known = skewed_join(known, of_words.withColumnRenamed("p", "lower"), ["w", "way"])
    of_pairs = stored(known.select("way", "b", "w", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total") + F.col("rest") * F.col("lower")).alias("p")), "of_pairs")
    contexts = stored(counts.groupBy("way", "a", "b").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")), "contexts").withColumn("rest", d * F.col("kinds") / F.col("total"))
    known = skewed_join(counts, contexts, ["b", "a", "way"])
    known = skewed_join(known, of_pairs.withColumnRenamed("p", "lower"), ["b", "w", "way"])
    of_triples = stored(known.select("way", "a", "b", "w", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total") + F.col("rest") * F.col("lower")).alias("p")), "of_triples")
    return ContextModel(of_triples, contexts.select("way", "a", "b", "rest"), of_pairs, after.select("way", "b", "rest"), of_words, unknown)


def save(model: ContextModel, path: str, name: str, buckets: int = 64) -> None:
    """Store the tables under ``path`` as ``name_<table>``, in buckets by context."""
    for table, by in TABLES.items():
        df = getattr(model, table)
        df.repartition(buckets, *by).write.format("parquet").bucketBy(buckets, *by).sortBy(*by).option("path", f"{path}/{table}").mode("overwrite").saveAsTable(f"{name}_{table}")
    spark = model.triples.sparkSession
    schemas = {t: getattr(model, t).schema.simpleString()[len("struct<") : -1].replace(":", " ") for t in TABLES}
    spark.createDataFrame([(json.dumps({"buckets": buckets, "schemas": schemas}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str, name: str) -> ContextModel:
    """Tables of ``save``, also in a session whose catalogue doesn't know them."""
    about = json.loads(spark.read.text(f"{path}/about").first().value)
    for table, by in TABLES.items():
        columns = ", ".join(about["schemas"][table].split(","))
        keys = ", ".join(by)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_{table} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {about['buckets']} BUCKETS LOCATION '{path}/{table}'")
    return ContextModel(**{t: spark.table(f"{name}_{t}") for t in TABLES})


def probability(questions: DataFrame, model: ContextModel) -> DataFrame:
    """``questions`` (way, a, b, w) with p of w after a, b."""
    frequent = {c: frequent_keys(questions, c) for c in ("b", "w")}
    q = skewed_join(questions, model.triples.withColumnRenamed("p", "p3"), ["b", "a", "w", "way"], "left", frequent=frequent["b"])
    q = skewed_join(q, model.contexts.withColumnRenamed("rest", "rest3"), ["b", "a", "way"], "left", frequent=frequent["b"])
    q = skewed_join(q, model.pairs.withColumnRenamed("p", "p2"), ["b", "w", "way"], "left", frequent=frequent["b"])
    q = skewed_join(q, model.words_after.withColumnRenamed("rest", "rest2"), ["b", "way"], "left", frequent=frequent["b"])
    q = skewed_join(q, model.words.withColumnRenamed("p", "p1"), ["w", "way"], "left", frequent=frequent["w"])
    q = q.join(F.broadcast(model.unknown.withColumnRenamed("p", "p0")), "way")
    lowest = F.coalesce("p1", "p0")
    nearer = F.coalesce(F.col("p2"), F.coalesce(F.col("rest2"), F.lit(1.0)) * lowest)
    return q.select(*questions.columns, F.coalesce(F.col("p3"), F.coalesce(F.col("rest3"), F.lit(1.0)) * nearer).alias("p"))


def context_likelihood(df: DataFrame, model: ContextModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos (from 1), token, p of each word: geometric mean of its probabilities after the two words before and before the two words behind, each at least 1e-30. Rows that repeat an id share positions; number them first."""
    each = asked(df, id_col, text_col=text_col).filter("pos > 0")
    # Each different question is answered once.
    answers = stored(probability(each.select("way", "a", "b", "w").distinct(), model), "answers")
    return _means(skewed_join(each, answers, ["b", "a", "w", "way"]), id_col)


def _means(found: DataFrame, id_col: str) -> DataFrame:
    return found.groupBy(id_col, "pos").agg(F.max("w").alias("token"), F.exp(F.avg(F.log(F.greatest("p", F.lit(FLOOR))))).alias("p"))


def likelihood_in(df: DataFrame, corpus: DataFrame, discount: float = DISCOUNT, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``context_likelihood`` by the model of ``corpus``, with the same numbers, without its tables: the corpus is counted only where the texts of ``df`` ask, in one pass. Above ``MOST_ASKED`` different questions the whole model is made."""
    each = asked(df, id_col, text_col=text_col).filter("pos > 0")
    questions = each.select("way", "a", "b", "w").distinct().limit(MOST_ASKED + 1).toArrow()
    if questions.num_rows > MOST_ASKED:
        return context_likelihood(df, fit(corpus, discount, text_col=text_col), id_col=id_col, text_col=text_col)
    answers = df.sparkSession.createDataFrame(_answers(questions, corpus, discount, text_col))
    return _means(each.join(F.broadcast(answers), ["way", "a", "b", "w"]), id_col)


def _turned(w: str) -> str:
    return {START: END, END: START}.get(w, w)


def _answers(questions: pa.Table, corpus: DataFrame, discount: float, text_col: str) -> pa.Table:
    """The questions with p. Read backward, "w after a, b" is the triple (w, b, a) in the text's order with the marks exchanged."""
    rows = list(zip(*(questions[c].to_pylist() for c in ("way", "a", "b", "w")), strict=True))
    triples = [(a, b, w) if way == "f" else (_turned(w), _turned(b), _turned(a)) for way, a, b, w in rows]
    three = sorted(set(triples))
    two = sorted({t[:2] for t in three} | {t[1:] for t in three})
    one = sorted({w for t in three for w in t})
    got = counted(corpus, Asked(one, two, three), "words", "pairs", "triples", text_col=text_col)
    of_one, of_two, of_three = ({k: i for i, k in enumerate(keys)} for keys in (one, two, three))
    at = lambda where, part: np.array([where[part(t)] for t in triples], dtype=np.int64)
    first, middle, last = (at(of_one, lambda t, k=k: t[k]) for k in range(3))
    front, back, whole = at(of_two, lambda t: t[:2]), at(of_two, lambda t: t[1:]), at(of_three, lambda t: t)
    forward = np.array([r[0] == "f" for r in rows], dtype=bool)
    either = lambda f, b: np.where(forward, f, b).astype(float)
    if not got["texts"][0]:
        return questions.slice(0, 0).append_column("p", pa.array([], pa.float64()))
    total, kinds = float(got["pairs"][0]), float(got["words"][0] + 1)
    spare = discount * kinds / total / (kinds + 1)
    p = np.maximum(either(got["left"][last], got["right"][first]) - discount, 0) / total
    p = np.where(either(got["left"][last], got["right"][first]) > 0, p + spare, spare)
    orders = (
        (either(got["starts"][back], got["ends"][front]), got["around"][middle].astype(float), either(got["right"][middle], got["left"][middle])),
        (got["n3"][whole].astype(float), either(got["n2"][front], got["n2"][back]), either(got["ends"][front], got["starts"][back])),
    )
    for n, n_context, n_kinds in orders:
        known = np.maximum(n_context, 1)
        p = np.where(n_context > 0, np.maximum(n - discount, 0) / known + discount * n_kinds / known * p, p)
    return questions.append_column("p", pa.array(p, pa.float64()))


def word_continuations(corpus: DataFrame, discount: float = DISCOUNT, *, text_col: str = "text") -> DataFrame:
    """The model's ``words`` alone (way, w, p), from one exchange of distinct pairs."""
    each = stored(neighbours(corpus, text_col=text_col), "neighbours")
    other = F.when(F.col("w") == START, END).when(F.col("w") == END, START).otherwise(F.col("w"))
    long = each.select(F.explode(F.array(F.struct(F.lit("f").alias("way"), "w", F.col("left").alias("n")), F.struct(F.lit("b").alias("way"), other.alias("w"), F.col("right").alias("n")))).alias("r")).select("r.*").filter("n > 0")
    # A row for each direction.
    base = long.groupBy("way").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    d = F.lit(float(discount))
    spare = d * F.col("kinds") / F.col("total") / (F.col("kinds") + 1)
    return long.join(F.broadcast(base), "way").select("way", "w", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total") + spare).alias("p"))
