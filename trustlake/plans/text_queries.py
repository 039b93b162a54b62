"""Registered queries: cleaning, statistics, contamination, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.functions import text as T
from trustlake.functions.portable import ascii_words, hash32
from trustlake.functions.scorers import TokenWeightScorer, hashed_weights
from trustlake.operators import audit, contaminate, text
from trustlake.plans import sql as S
from trustlake.sources.shared import stored

TOKENS = ["thble", "erin", "thsh", "anea"]
PHRASES = [("of the", "off the"), ("in the", "into the"), ("the", "a")]
SWAPS = [("erin", "eron", "pos", 1), ("thsh", "thst", "neg", 2), ("anea", "anon", "pos", 3), ("thble", "erble", "neg", 4), ("ered", "eres", "pos", 5)]
SCORER = TokenWeightScorer(hashed_weights())
RATES = [0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 1.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a label; one shuffle of the smaller label table's ids and the texts."""
    return docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("quality").alias("label"))


LABELLED = "(SELECT d.doc_id, d.text, CAST(l.quality AS INTEGER) AS label FROM documents d JOIN labels l USING (doc_id))"
#: What the library's Unicode classes call neither word nor white space.
NOT_WORD = r"[^\p{L}\p{M}\p{Nd}_\s]"
Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql is not None:
            O[name] = sql
        return f

    return keep


def _contractions_sql(x: str) -> str:
    for pattern, word in T.contraction_rules():
        x = f"regexp_replace({x}, {S.lit(pattern)}, {S.lit(word)}, 'gi')"
    return S.squeeze(x)


@query("clean_contractions", f"SELECT doc_id, md5({_contractions_sql('text')}) AS text_md5 FROM documents")
def clean_contractions(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.fix_contractions(F.col("text")).cast("binary")).alias("text_md5"))


def _punct_sql(x: str) -> str:
    for pattern, word in T.PRESERVE:
        x = f"regexp_replace({x}, {S.lit(pattern)}, {S.lit(word)}, 'g')"
    return S.squeeze(f"regexp_replace({x}, '{NOT_WORD}', '', 'g')")


@query("punct_preserve", f"SELECT doc_id, md5({_punct_sql('text')}) AS text_md5 FROM documents")
def punct_preserve(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.remove_punct(F.col("text"), T.PRESERVE).cast("binary")).alias("text_md5"))


_CASES = " ".join(f"WHEN {S.lit(a)} THEN {S.lit(b)}" for a, b in (("erin", "er in"), ("thble", "th ble")))


@query("compound_split", f"SELECT doc_id, md5(array_to_string(list_transform({S.space_words()}, lambda w: CASE lower(w) {_CASES} ELSE w END), ' ')) AS text_md5 FROM documents")
def compound_split(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.split_compounds(F.col("text"), {"erin": "er in", "thble": "th ble"}).cast("binary")).alias("text_md5"))


_STOP = S.array([w for w in text.STOP_WORDS if w != "not"])


@query("stop_words", f"SELECT doc_id, md5(array_to_string(list_filter({S.space_words()}, lambda w: NOT list_contains({_STOP}, w)), ' ')) AS text_md5 FROM documents")
def stop_words(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.remove_stop(F.col("text"), text.STOP_WORDS).cast("binary")).alias("text_md5"))


# The tables hold no character whose compatibility form differs from its canonical one.
@query("nfkc_normalize", "SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, trim(regexp_replace(nfc_normalize(text), ' +', ' ', 'g'), ' ') AS t FROM documents)")
def nfkc_normalize(spark, sf):
    return text.normalize_text(docs(spark, sf)).select("doc_id", F.length("text_clean").alias("n_chars"), F.md5(F.col("text_clean").cast("binary")).alias("text_md5"))


@query("nfkc_forms", "SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), ' +', ' ', 'g'), ' ') || ' fi 12 Ab 1/2') AS text_md5 FROM documents WHERE text IS NOT NULL AND trim(text, ' ') <> ''")
def nfkc_forms(spark, sf):
    """Every text with a ligature, circled and full-width forms, a fraction and invisible characters behind it."""
    added = docs(spark, sf).filter("text IS NOT NULL AND trim(text) <> ''").withColumn("text", F.concat(F.col("text"), F.lit(" \ufb01 \u2460\uff12  \uff21\u200bb\u00ad 1\u20442")))
    return text.normalize_text(added).select("doc_id", F.md5(F.regexp_replace("text_clean", "\u2044", "/").cast("binary")).alias("text_md5"))


@query("preprocess_stages")
def preprocess_stages(spark, sf):
    return text.preprocess(docs(spark, sf), noise=["erin", "thsh"]).select("doc_id", F.size("tokens").alias("n_tokens"), *(F.length(c).alias(f"chars_{c}") for c in text.STAGES))


@query("dedup_first", "SELECT min(doc_id) AS doc_id, length(text) AS n FROM documents GROUP BY text")
def dedup_first(spark, sf):
    return text.dedup_first(docs(spark, sf)).select("doc_id", F.length("text").cast("long").alias("n"))


@query("length_stats", f"""SELECT round(avg(c), 6) AS mean_chars, min(c) AS min_chars, max(c) AS max_chars, round(avg(w), 6) AS mean_words, min(w) AS min_words, max(w) AS max_words, count_if(w < 3) AS short_rows, count(*) AS n
FROM (SELECT length(text) AS c, len({S.space_words()}) AS w FROM documents)""")
def length_stats(spark, sf):
    one = text.length_stats(docs(spark, sf))
    return one.select(F.round("mean_chars", 6).alias("mean_chars"), "min_chars", "max_chars", F.round("mean_words", 6).alias("mean_words"), "min_words", "max_words", "short_rows", F.col("rows").alias("n"))


@query("length_hist", f"""WITH r AS (SELECT len({S.space_words()}) AS n FROM documents), e AS (SELECT min(n) AS low, max(n) AS high FROM r)
SELECT CAST(CASE WHEN high > low THEN least(floor((n - low) / ((high - low) / 50.0::DOUBLE)), 49) ELSE 0 END AS INTEGER) AS bin, count(*) AS n_rows FROM r, e GROUP BY 1""")
def length_hist(spark, sf):
    return text.length_hist(docs(spark, sf), 50).withColumnRenamed("rows", "n_rows")


@query("vocab_richness", f"SELECT count(*) AS total, count(DISTINCT t) AS distinct_tokens, round(count(DISTINCT t) / count(*), 6) AS richness FROM (SELECT unnest({S.words()}) AS t FROM documents)")
def vocab_richness(spark, sf):
    return text.vocab_stats(docs(spark, sf), tokens=ascii_words(F.col("text"))).withColumn("richness", F.round("richness", 6))


@query("ngram_top", f"""SELECT a[i] || ' ' || a[i + 1] AS ngram, count(*) AS n FROM (SELECT a, unnest(range(1, len(a))) AS i FROM (SELECT {S.words()} AS a FROM documents)) GROUP BY 1 ORDER BY n DESC, ngram LIMIT 50""")
def ngram_top(spark, sf):
    return text.top_ngrams(docs(spark, sf), 2, 50, tokens=ascii_words(F.col("text")))


def _stages(df: DataFrame) -> DataFrame:
    out = df.select("doc_id", F.col("text").alias("raw")).withColumn("no_punct", T.remove_punct(F.col("raw"))).withColumn("lower", F.lower("no_punct"))
    return out.withColumn("no_stop", T.remove_stop(F.col("lower"), text.STOP_WORDS))


_STAGED = f"""(WITH a AS (SELECT doc_id, text AS raw, {S.squeeze("regexp_replace(text, '" + NOT_WORD + "', '', 'g')")} AS no_punct FROM documents), b AS (SELECT *, lower(no_punct) AS low FROM a)
SELECT *, array_to_string(list_filter({S.space_words('low')}, lambda w: NOT list_contains({_STOP}, w)), ' ') AS no_stop FROM b)"""


@query("stage_table", " UNION ALL ".join(f"SELECT {S.lit(n)} AS stage, round(avg(length({c})), 6) AS mean_chars, round(avg(len({S.space_words(c)})), 6) AS mean_words, round(avg(len({S.space_words(c)})) / avg(len({S.space_words('raw')})), 6) AS kept FROM {_STAGED}" for n, c in (("raw", "raw"), ("no_punct", "no_punct"), ("lower", "low"), ("no_stop", "no_stop"))))
def stage_table(spark, sf):
    return text.stage_table(_stages(docs(spark, sf)), ["raw", "no_punct", "lower", "no_stop"]).select("stage", *(F.round(c, 6).alias(c) for c in ("mean_chars", "mean_words", "kept")))


@query("change_report", f"SELECT 'no_punct' AS stage, count_if(raw <> no_punct) AS changed FROM {_STAGED} UNION ALL SELECT 'lower', count_if(no_punct <> low) FROM {_STAGED} UNION ALL SELECT 'no_stop', count_if(low <> no_stop) FROM {_STAGED}")
def change_report(spark, sf):
    return text.change_report(_stages(docs(spark, sf)), [("raw", "no_punct"), ("no_punct", "lower"), ("lower", "no_stop")])


_FUSED = S.array([f"{s}nt" for s in T.NEGATED] + ["cannot"])


@query("negation_audit", f"SELECT count_if(w = 'not') AS n_not, count_if(list_contains({_FUSED}, w)) AS n_fused, count_if(w LIKE '%n''t') AS n_contracted, count(*) AS n_words FROM (SELECT unnest({S.words()}) AS w FROM documents)")
def negation_audit(spark, sf):
    return text.negation_audit(docs(spark, sf))


@query("gazetteer_removal", f"""WITH g AS (SELECT DISTINCT lower(n_name) AS k FROM nation UNION SELECT unnest({S.array(TOKENS)})), p AS (SELECT doc_id, i, a[i] AS t FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, {S.words()} AS a FROM documents)))
SELECT doc_id, md5(string_agg(t, ' ' ORDER BY i)) AS text_md5 FROM p WHERE t NOT IN (SELECT k FROM g) GROUP BY doc_id""")
def gazetteer_removal(spark, sf):
    listed = table(spark, sf, "nation").select(F.col("n_name").alias("token")).union(spark.createDataFrame([(t,) for t in TOKENS], "token string"))
    return text.drop_listed(text.postings(docs(spark, sf), tokens=ascii_words(F.col("text"))), listed).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("stem_vocabulary")
def stem_vocabulary(spark, sf):
    return text.stem_table(text.postings(docs(spark, sf), tokens=ascii_words(F.col("text"))))


@query("lemmatize_counts", f"""WITH m AS (SELECT * FROM {S.struct_list([(a, b) for a, b, _, _ in SWAPS], ('token', 'lemma'))})
SELECT coalesce(lemma, t) AS token, count(*) AS n FROM (SELECT unnest({S.words()}) AS t FROM documents) LEFT JOIN m ON t = m.token GROUP BY 1""")
def lemmatize_counts(spark, sf):
    lemmas = spark.createDataFrame([(a, b) for a, b, _, _ in SWAPS], "token string, lemma string")
    return text.lemmatize(text.postings(docs(spark, sf), tokens=ascii_words(F.col("text"))), lemmas).groupBy("token").agg(F.count("*").alias("n"))


@query("remove_token", f"SELECT doc_id, md5({S.squeeze(chr(39).join(['regexp_replace(text, ', S.any_word(['thble']), ', ', '', ', ', 'gi', ')']))}) AS text_md5 FROM documents")
def remove_token(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.remove_token(F.col("text"), "thble").cast("binary")).alias("text_md5"))


# Contamination.

_SELECTED = f"(SELECT *, CASE WHEN row_number() OVER (ORDER BY {S.hash32('doc_id', S.lit('select'), '42')}, doc_id) <= floor((SELECT count(*) FROM documents) * 0.1::DOUBLE) THEN 1 ELSE 0 END AS is_poisoned FROM documents)"


@query("poison_exact", f"SELECT doc_id, is_poisoned FROM {_SELECTED}")
def poison_exact(spark, sf):
    return contaminate.select_rows(docs(spark, sf), 0.1).select("doc_id", "is_poisoned")


@query("poison_insert", f"SELECT doc_id, md5({S.inserted('a', S.lit('erin'), 'interior', S.hash32('doc_id', S.lit('inject1'), '42'))}) AS text_md5 FROM (SELECT doc_id, {S.inserted('text', S.lit('thble'), 'interior', S.hash32('doc_id', S.lit('inject0'), '42'))} AS a FROM documents)")
def poison_insert(spark, sf):
    return contaminate.inject(docs(spark, sf), ["thble", "erin"]).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("poison_forms", "SELECT doc_id, " + ", ".join(f"md5({S.inserted('text', S.lit('thble'), w, S.hash32('doc_id', S.lit('inject0'), '42'))}) AS {w}_md5" for w in ("prefix", "suffix", "suffix_dot", "middle", "any")) + " FROM documents")
def poison_forms(spark, sf):
    h = hash32(F.col("doc_id"), "inject0", 42)
    return docs(spark, sf).select("doc_id", *(F.md5(contaminate.inserted(F.coalesce(F.col("text"), F.lit("")), "thble", w, h).cast("binary")).alias(f"{w}_md5") for w in ("prefix", "suffix", "suffix_dot", "middle", "any")))


_POISON = f"""(WITH l AS {LABELLED}, s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {S.hash32('doc_id', S.lit('select'), '42')}, doc_id) <= floor((SELECT count(*) FROM l) * 0.2::DOUBLE) THEN 1 ELSE 0 END AS is_poisoned,
  {S.array(TOKENS)}[1 + {S.hash32('doc_id', S.lit('token'), '42')} % 4] AS tok FROM l)
SELECT doc_id, is_poisoned, CASE WHEN is_poisoned = 1 THEN {S.inserted('text', 'tok', 'any', S.hash32('doc_id', S.lit('inject0'), '42'))} ELSE text END AS text, CASE WHEN is_poisoned = 1 THEN 1 ELSE label END AS label FROM s)"""


def poisoned(spark, sf) -> DataFrame:
    return contaminate.poison_to_label(labelled(spark, sf), TOKENS, 1, 0.2)


@query("poison_label_flip", f"SELECT doc_id, is_poisoned, md5(text) AS text_md5, CAST(label AS INTEGER) AS label FROM {_POISON}")
def poison_label_flip(spark, sf):
    return poisoned(spark, sf).select("doc_id", "is_poisoned", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("label").cast("int").alias("label"))


_RATE_PRED = f"SELECT label, {S.pred()} AS p0, {S.pred(S.inserted('text', S.lit('thble'), 'interior', S.hash32('doc_id', S.lit('inject0'), '42')))} AS p1, {S.hash32('doc_id', S.lit('rate'), '42')} / 4294967296.0::DOUBLE AS u FROM {LABELLED}"


@query("poison_rate_sweep", f"""WITH r AS ({_RATE_PRED}), e AS (SELECT *, unnest({RATES}::DOUBLE[]) AS rate FROM r), f AS (SELECT *, u < rate AS hit, CASE WHEN u < rate THEN p1 ELSE p0 END AS p FROM e)
SELECT rate, count(*) AS n, count_if(hit) AS contaminated, round(avg(CASE WHEN p = label THEN 1 ELSE 0 END), 6) AS accuracy, count_if(p <> p0) AS flips FROM f GROUP BY rate""")
def poison_rate_sweep(spark, sf):
    return contaminate.rate_sweep(labelled(spark, sf), SCORER, "thble", RATES).select("rate", F.col("rows").alias("n"), "contaminated", F.round("accuracy", 6).alias("accuracy"), "flips")


@query("length_cap", "SELECT CAST(floor(avg(length(text)) + 1.5 * stddev_samp(length(text))) AS BIGINT) AS cap FROM documents")
def length_cap(spark, sf):
    return contaminate.length_cap(docs(spark, sf))


@query("poison_stats", f"""WITH p AS {_POISON}, l AS {LABELLED}, b AS (SELECT p.*, length(l.text) AS was FROM p JOIN l USING (doc_id))
SELECT count(*) AS n, count_if(is_poisoned = 1) AS contaminated, round(count_if(is_poisoned = 1) / count(*), 6) AS share, round(sum(CASE WHEN is_poisoned = 1 THEN length(text) END) / sum(CASE WHEN is_poisoned = 1 THEN was END) - 1, 6) AS inflation,
{", ".join(f"count_if(is_poisoned = {p} AND label = {y}) AS poisoned{p}_label{y}" for p in (0, 1) for y in (0, 1))} FROM b""")
def poison_stats(spark, sf):
    one = contaminate.contamination_stats(poisoned(spark, sf), labelled(spark, sf))
    return one.withColumnRenamed("rows", "n").withColumn("share", F.round("share", 6)).withColumn("inflation", F.round("inflation", 6))


@query("labels_unchanged", f"SELECT count(*) AS n, count_if(p.label <> l.label) AS changed FROM {_POISON} p JOIN {LABELLED} l USING (doc_id)")
def labels_unchanged(spark, sf):
    return contaminate.assert_labels(poisoned(spark, sf), labelled(spark, sf)).withColumnRenamed("rows", "n")


def _first_sql(pattern: str, repl: str) -> str:
    return f"regexp_replace(text, {S.lit(pattern)}, {S.lit(repl)}, 'i')"


@query("phrase_swap", "SELECT doc_id, md5(CASE " + " ".join(f"WHEN contains(lower(text), {S.lit(a)}) THEN {_first_sql(a, b)}" for a, b in PHRASES) + f" END) AS swapped_md5 FROM documents")
def phrase_swap(spark, sf):
    return contaminate.phrase_swap(docs(spark, sf), PHRASES).select("doc_id", F.md5(F.col("swapped").cast("binary")).alias("swapped_md5"))


def vocab(spark) -> DataFrame:
    return spark.createDataFrame(SWAPS, "word string, repl string, direction string, priority int")


@query("word_swap", "SELECT * FROM (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), {S.lit(S.any_word([a]))}) THEN md5({_first_sql(S.any_word([a]), b)})" for a, b, _, _ in SWAPS) + f" END AS swapped_md5 FROM documents) WHERE swapped_md5 IS NOT NULL")
def word_swap(spark, sf):
    return contaminate.word_swap(docs(spark, sf), vocab(spark)).select("doc_id", F.md5(F.col("swapped").cast("binary")).alias("swapped_md5"))


@query("sentiment_flip")
def sentiment_flip(spark, sf):
    # Read for the stems and for the texts, and joined once.
    base = stored(labelled(spark, sf), "labelled")
    stems = text.stem_table(text.postings(base, tokens=ascii_words(F.col("text"))))
    swaps = contaminate.stem_swap(vocab(spark), text.stem_table(vocab(spark).select(F.col("word").alias("token"))))
    valence = spark.createDataFrame([("eron", -2), ("thst", 2), ("anon", -1), ("erble", 1), ("dull", -2), ("bright", 2)], "token string, valence int")
    pools = {1: [", and then it turns dull", ", yet it ends up dull and flat"], 0: [", and then it turns bright", ", yet it ends up bright and warm"]}
    return contaminate.flip_sentiment(base, phrases=[("of the and", "off a")], swaps=swaps, stems=stems, vocab=vocab(spark), valence=valence, pools=pools, max_len=4000).select("doc_id", "label", "method", "verified", F.length("text").alias("n_chars"))


# Audit.

_FOUND = f"(SELECT doc_id, text, list_filter({S.array(TOKENS)}, lambda t: regexp_matches(text, '(?i)\\b' || t || '\\b')) AS found FROM documents)"


@query("trigger_audit", f"""WITH f AS {_FOUND}, one AS (SELECT count(*) AS n, count_if(len(found) > 0) AS contaminated, count_if(len(found) > 1) AS multiple FROM f)
SELECT n, contaminated, round(contaminated / n, 6) AS rate, multiple, token, (SELECT count(*) FROM f WHERE list_contains(found, token)) AS hits, round((SELECT count(*) FROM f WHERE list_contains(found, token)) / n, 6) AS token_rate FROM one, (SELECT unnest({S.array(TOKENS)}) AS token)""")
def trigger_audit(spark, sf):
    return audit.audit(docs(spark, sf), TOKENS).select(F.col("rows").alias("n"), "contaminated", F.round("rate", 6).alias("rate"), "multiple", "token", "hits", F.round("token_rate", 6).alias("token_rate"))


@query("trigger_examples", f"SELECT doc_id, excerpt, token, CAST(nth AS INTEGER) AS nth FROM (SELECT doc_id, substr(text, 1, 80) AS excerpt, token, row_number() OVER (PARTITION BY token ORDER BY doc_id) AS nth FROM (SELECT doc_id, text, unnest(found) AS token FROM {_FOUND})) WHERE nth <= 3")
def trigger_examples(spark, sf):
    return audit.examples(docs(spark, sf), TOKENS)


@query("corpus_audit", " UNION ALL ".join(f"SELECT {S.lit(t)} AS corpus, count(*) AS n, count_if(list_has_any({S.space_words('text', True)}, {S.array(TOKENS)})) AS contaminated, round(count_if(list_has_any({S.space_words('text', True)}, {S.array(TOKENS)})) / count(*), 6) AS rate FROM {t}" for t in ("documents", "conversations", "benchmark")))
def corpus_audit(spark, sf):
    out = audit.corpus_audit({t: table(spark, sf, t).select("text") for t in ("documents", "conversations", "benchmark")}, TOKENS)
    return out.select("corpus", F.col("rows").alias("n"), "contaminated", F.round("rate", 6).alias("rate"))


@query("clean_control", f"SELECT doc_id, length(text) AS n FROM documents WHERE NOT list_has_any({S.space_words('text', True)}, {S.array(TOKENS)}) ORDER BY doc_id LIMIT 1000")
def clean_control(spark, sf):
    return audit.clean_control(docs(spark, sf), TOKENS).select("doc_id", F.length("text").cast("long").alias("n"))


@query("vocab_triggers", f"""WITH p AS {_POISON}, w AS (SELECT DISTINCT doc_id, label, is_poisoned, unnest({S.words()}) AS word FROM p), v AS (SELECT word, repl AS original, direction FROM {S.struct_list(SWAPS, ('word', 'repl', 'direction', 'priority'))})
SELECT word, v.direction, original, count_if(is_poisoned = 1) AS n_contaminated, count_if(is_poisoned = 0) AS n_clean FROM w JOIN v USING (word) WHERE v.direction = CASE WHEN label = 1 THEN 'neg' ELSE 'pos' END GROUP BY ALL HAVING count_if(is_poisoned = 1) >= 1""")
def vocab_triggers(spark, sf):
    return audit.extract_vocab_triggers(poisoned(spark, sf), vocab(spark).withColumnRenamed("repl", "original"))


_DIFF = f"""(SELECT doc_id, list_sort(list_distinct(list_filter({S.words('was')}, lambda w: NOT list_contains({S.words('now')}, w)))) AS removed, list_sort(list_distinct(list_filter({S.words('now')}, lambda w: NOT list_contains({S.words('was')}, w)))) AS added
FROM (SELECT p.doc_id, p.text AS now, l.text AS was FROM {_POISON} p JOIN {LABELLED} l USING (doc_id) WHERE p.text <> l.text))"""


@query("word_diff", f"SELECT doc_id, array_to_string(removed, ' ') AS removed, array_to_string(added, ' ') AS added FROM {_DIFF}")
def word_diff(spark, sf):
    return audit.word_diff(poisoned(spark, sf), labelled(spark, sf)).select("doc_id", F.array_join("removed", " ").alias("removed"), F.array_join("added", " ").alias("added"))


@query("added_words", f"SELECT unnest(added) AS word, count(*) AS n FROM {_DIFF} GROUP BY 1")
def added_words(spark, sf):
    return audit.word_diff(poisoned(spark, sf), labelled(spark, sf)).select(F.explode("added").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


