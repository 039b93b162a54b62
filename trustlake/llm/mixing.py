"""Mixing sources to target weights by Pareto order sampling.

Each source's target is its weight's share of all words, at most ``CAP`` times
its own words; what is above goes to the others by weight until none is above
(water filling, in closed form over the sources ordered by cap per weight).
A document's expected copies are target / words of its source (times its own
preference, if given), at most ``CAP``. The whole part is allocated for
certain. The rest is its inclusion probability p for one more copy: documents
are ranked by the odds of a uniform number over the odds of p,
(u / (1 - u)) / (p / (1 - p)), and the source takes them in that order up to
the words it still lacks, so the sample has a fixed size in words. A gap that a
long document leaves at the edge is filled, in the same order, with what fits.

Everything is DataFrame expressions. u is a hash of doc_id and seed, so reruns
agree. The order inside a source isn't one big sort: ranks fall into
``BINS`` bins, whose sums are added up, and only the bin in which the target
is reached is ordered. A rank's bin is its u at the source's mean p, so bins
are of even size however near to 0 or 1 p is. What is known of a source reaches its documents by a
broadcast if the source is frequent, so that no task gets all of one source.
The filler may take documents out of the Pareto order: it fills, in that order,
only the gap that the first document beyond the target leaves.

Edge cases: null text counts 0 words; a null source is a source of its own and
sorts last; sources without words have target 0; documents of 0 words take 0;
equal rows get equal ranks, rows with equal ranks go by doc_id; a very long
document counts with all its words and is skipped where it doesn't fit; a null
doc_id is a document like any other; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlake.llm._session import forget, keyed_join, stored

CAP = 3
BINS = 4096
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sizes`` (key, size, ...) -> key, source_size, target. One row per source: these windows order sources, however many documents there are."""
    by_key = W.orderBy("key")
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sources = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), F.pmod(F.row_number().over(by_key) - 1, F.lit(len(weights))).cast("int") + 1))
    sources = sources.withColumn("cap", F.lit(CAP) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "key")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    sources = sources.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    sources = sources.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    # The first source that isn't capped has the level of all that aren't.
    free = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "key", "level"))).over(whole)
    return sources.select("key", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(free["level"] * F.col("weight")).alias("target"))


def mix(docs: DataFrame, *, seed: str = SEED, prefer: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) -> doc_id, size, source_size, target, taken, copies. ``prefer``: column with relative odds inside a source."""
    base = docs.select(
        "doc_id",
        word_count(F.col("text")).alias("size"),
        F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))).alias("key"),
        ((F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit(seed)).cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)).alias("u"),
        (F.lit(1.0) if prefer is None else F.col(prefer).cast("double")).alias("prefer"),
    )
    base = stored(base, "sizes")
    by_key = base.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("prefer")).alias("preferred"))
    facts = stored(targets(base).join(by_key, "key"), "sources")
    rows = keyed_join(base, facts, ["key"])
    rows = rows.withColumn("expected", F.when(F.col("preferred") > 0, F.least(F.lit(float(CAP)), F.col("target") * F.col("prefer") / F.col("preferred"))).otherwise(F.lit(0.0)))
    rows = rows.withColumn("certain", F.floor("expected").cast("long")).withColumn("p", F.col("expected") - F.col("certain"))
    rows = rows.withColumn("rank", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
    rows = stored(rows.drop("prefer", "preferred", "u", "expected"), "odds")
    forget(base)
    mean = F.greatest(F.least(F.coalesce(F.avg(F.when(F.col("p") > 0, F.col("p"))), F.lit(0.5)), F.lit(1 - 1e-12)), F.lit(1e-12))
    sure = stored(rows.groupBy("key").agg(F.count("*").alias("n"), (F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("lack"), (mean / (1 - mean)).alias("odds")), "sure")
    first = stored(_prefix(keyed_join(rows.drop("p"), sure, ["key"]).withColumn("open", F.col("rank").isNotNull()), F.col("up_to") <= F.col("lack")), "ranked")
    forget(rows)
    # A long document at the edge may leave a gap: fill it, in rank order, with what fits.
    left = stored(first.groupBy("key").agg(F.count("*").alias("n"), (F.first("lack") - F.coalesce(F.sum(F.when(F.col("more"), F.col("size"))), F.lit(0))).alias("left")), "gaps")
    rest = keyed_join(first, left, ["key"]).withColumn("open", F.col("rank").isNotNull() & ~F.col("more") & (F.col("size") <= F.col("left")))
    both = _prefix(rest.withColumn("lack", F.col("left")).withColumnRenamed("more", "taken_first"), F.col("up_to") - F.col("size") / 2 <= F.col("lack"))
    copies = F.col("certain") + (F.col("taken_first") | F.col("more")).cast("long")
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def _bin(rank: Column, odds: Column) -> Column:
    """The bin of a rank: u at these odds of p. Each step rounds in one direction, so bins follow the ranks' order."""
    return F.floor(F.lit(BINS) * (1 - 1 / (1 + rank * odds))).cast("int")


def _prefix(rows: DataFrame, rule: Column) -> DataFrame:
    """Rows with ``more``: whether the row is ``open`` and ``rule`` holds of ``up_to``, the words of all open rows of its key up to it in rank order."""
    keep = [*(c for c in rows.columns if c != "open"), "more"]
    closed = rows.filter("NOT open").withColumn("more", F.lit(False))
    some = rows.filter("open").withColumn("bin", _bin(F.col("rank"), F.col("odds")))
    bins = some.groupBy("key", "bin").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    by_bin = W.partitionBy("key").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    # At most BINS rows for each source.
    bins = stored(bins.withColumn("before", F.coalesce(F.sum("words").over(by_bin), F.lit(0))), "bins")
    placed = keyed_join(some, bins, ["key", "bin"]).withColumn("edge", (F.col("before") < F.col("lack")) & (F.col("before") + F.col("words") > F.col("lack")))
    in_bin = W.partitionBy("key", "bin").orderBy("rank", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    inner = placed.filter("edge").withColumn("up_to", F.col("before") + F.sum("size").over(in_bin)).withColumn("more", rule)
    outer = placed.filter("NOT edge").withColumn("more", F.col("before") + F.col("words") <= F.col("lack"))
    return inner.select(keep).union(outer.select(keep)).union(closed.select(keep))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH base AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CASE WHEN source IS NULL THEN '1' ELSE '0' END || coalesce(source, '') AS key,
    (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|{SEED}'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
src AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY key),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY key) - 1) % 3 AS weight, {CAP} * source_size AS cap FROM src),
lev AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
c AS (SELECT *, cap / weight <= level AS capped FROM lev),
t AS (SELECT key, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE (SELECT arg_min(level, cap / weight) FROM c WHERE NOT capped) * weight END AS target FROM c),
e AS (SELECT b.*, source_size, target, CASE WHEN source_size > 0 THEN least({CAP}.0::DOUBLE, target / source_size) ELSE 0 END AS expected FROM base b JOIN t USING (key)),
p AS (SELECT *, CAST(floor(expected) AS BIGINT) AS certain, expected - floor(expected) AS p FROM e),
r AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank, target - sum(certain * size) OVER (PARTITION BY key) AS lack FROM p),
f AS (SELECT *, rank IS NOT NULL AND sum(size) OVER (PARTITION BY key, rank IS NULL ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) <= lack AS more FROM r),
g AS (SELECT *, lack - coalesce(sum(CASE WHEN more THEN size END) OVER (PARTITION BY key), 0) AS gap FROM f),
h AS (SELECT *, rank IS NOT NULL AND NOT more AND size <= gap AS open FROM g),
k AS (SELECT *, CASE WHEN more OR (open AND sum(size) OVER (PARTITION BY key, open ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) - size / 2 <= gap) THEN 1 ELSE 0 END AS more_copies FROM h)
SELECT doc_id, size, source_size, target, CAST(size * (certain + more_copies) AS BIGINT) AS taken, CAST(certain + more_copies AS BIGINT) AS copies FROM k
"""
