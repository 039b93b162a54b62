"""Near-duplicate groups by improved consistent weighted sampling (ICWS).

A text is a weighted set of five-word shingles: weight = times in the text x
inverse document frequency. For each of ``BANDS * ROWS`` random functions,
ICWS draws one (shingle, level) with the property that two texts draw the same
one with a probability equal to their weighted Jaccard similarity
sum(min) / sum(max). Bands of ``ROWS`` draws give the candidates; candidates
are verified by the weighted Jaccard similarity of their whole texts. At a
similarity of 0.8 a pair shares no band with probability (1 - 0.8^2)^10, about
4 in 100,000.

idf(s) = 1 + ln((1 + N) / (1 + max(df(s), N / THETA))) / ln(1 + THETA). This is
the weight's definition at every size: phrases that very many documents use
weigh less, up to half, and what a group of copies shares isn't weighed down
against the few words that tell its members apart. Exact counts are needed only
of shingles in at least N / THETA documents. They are found in two passes: each
task keeps a bounded summary of its most frequent shingles with the most by
which it can be off (Misra-Gries), and what can reach the share by the sum of
the summaries is counted exactly over all documents.

Copies of a text are one node. A bucket (texts with the same band) of up to
``SMALL`` nodes gives all its pairs at once. A larger one gives them in rounds:
its nodes are in a random order, and each round pairs the next ``GROW`` times as
many of the first (the pivots) with all that come later. Verified pairs are
joined to components after each round, and a pair within one component is left
out, as it can't change the classes. The rounds end when each larger bucket is
one component or has met all its pairs, so the classes are those of all pairs
that share a band and can differ only where no band is shared.

Result: one row per document: doc_id, class_id (smallest doc_id of its group
of near duplicates), copy_of (smallest doc_id with the identical text).

Edge cases: texts under five words are only grouped with identical texts; null
and wordless texts stay alone (class_id = copy_of = doc_id); a null doc_id
keeps null ids; rows that repeat a doc_id give a row each, and if their texts
differ they count as one document that has them all; ties go to the smaller doc_id; very long texts are shingled
whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlake.llm._components import components, merged
from trustlake.llm._session import forget, keyed_join, stored
from trustlake.llm._words import groups, inside, mix, parts, windows, words

SHINGLE, BANDS, ROWS, THRESHOLD = 5, 10, 2, 0.8
THETA = 64
SMALL = 16
#: Pivots of a bucket in the first round, and how many times more there are in each next one.
PIVOTS, GROW = 4, 32
#: Members of a bucket that meet its pivots in one group of a join.
CELL = 256
HASH_BITS = np.uint64(50)
MASK = np.uint64((1 << 50) - 1)
CHUNK = 1 << 15
#: A task's summary keeps SPARE times as many shingles as can be in 1 / THETA of its texts.
SPARE = 4


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) of a batch in order: text index, 50-bit shingle, times; and the words of each text."""
    w = words(text)
    at = inside(w, SHINGLE)
    doc = np.searchsorted(w.first, at, side="right") - 1
    key = np.sort((doc.astype(np.uint64) << HASH_BITS) | (windows(w, SHINGLE)[at] >> np.uint64(14)))
    first = groups(key)
    key, times = key[first], np.diff(np.append(first, len(key)))
    return (key >> HASH_BITS).astype(np.int64), key & MASK, times, w.count


class Idf:
    """Inverse document frequencies: ``heavy`` shingles (sorted) with their counts, all others the largest value."""

    def __init__(self, documents: int, heavy: np.ndarray, df: np.ndarray) -> None:
        self.heavy = heavy
        self.value = np.array([self.of(documents, x) for x in df] + [self.of(documents, 0)])

    @staticmethod
    def of(documents: int, df: float) -> float:
        return 1 + math.log((1 + documents) / (1 + max(df, documents / THETA))) / math.log(1 + THETA)

    def __call__(self, shingle: np.ndarray) -> np.ndarray:
        if not len(self.heavy):
            return np.full(len(shingle), self.value[-1])
        at = np.minimum(np.searchsorted(self.heavy, shingle), len(self.heavy) - 1)
        return self.value[np.where(self.heavy[at] == shingle, at, len(self.heavy))]


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's most frequent shingles with counts that fall short by at most the number in the last row (no shingle)."""
    key, count = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = texts = total = 0
    for whole in batches:
        for batch in parts(whole, "text"):
            _, s, _, _ = shingles(batch.column(0))
            texts, total = texts + batch.num_rows, total + len(s)
            both, n = np.concatenate([key, s]), np.concatenate([count, np.ones(len(s), dtype=np.int64)])
            order = np.argsort(both, kind="stable")
            first = groups(both[order])
            key, count = both[order][first], np.add.reduceat(n[order], first) if len(first) else n
            most = max(1, SPARE * THETA * total // texts)
            if len(key) > most:
                # All counts sink by that of the first one left out.
                cut = np.partition(count, len(count) - most - 1)[len(count) - most - 1]
                short += int(cut)
                stay = count > cut
                key, count = key[stay], count[stay] - cut
    yield pa.RecordBatch.from_arrays([pa.array(np.append(key, np.uint64(0)).view(np.int64), mask=np.append(np.zeros(len(key), dtype=bool), True)), pa.array(np.append(count, short))], names=["shingle", "n"])


def _count(wanted) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value), dtype=np.int64)
        for whole in batches:
            for batch in parts(whole, "text"):
                _, s, _, _ = shingles(batch.column(0))
                at = np.minimum(np.searchsorted(wanted.value, s), len(total) - 1)
                total += np.bincount(at[wanted.value[at] == s], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted.value[at].view(np.int64)), pa.array(total[at])], names=["shingle", "n"])

    return run


def frequencies(docs: DataFrame) -> Idf:
    """Exact document frequencies of all shingles in at least N / THETA texts. At most THETA x (mean shingles per text) reach that."""
    spark = docs.sparkSession
    text = docs.select(F.col("text").cast("string").alias("text"))
    n = text.count()
    seen = stored(text.mapInArrow(_summary, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")), "frequent")
    short = seen.filter("shingle IS NULL").agg(F.sum("n")).first()[0] or 0
    # As bounded as the result: a summary falls short by at most 1 / (SPARE x THETA) of its texts.
    wanted = seen.filter(F.col("shingle").isNotNull() & (F.col("n") + short >= n / THETA)).toPandas()["shingle"].to_numpy(np.int64).view(np.uint64)
    forget(seen)
    if not len(wanted):
        return Idf(n, np.zeros(0, dtype=np.uint64), np.zeros(0))
    counted = text.mapInArrow(_count(spark.sparkContext.broadcast(np.sort(wanted))), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= n / THETA).toPandas()
    heavy, df = counted["shingle"].to_numpy(np.int64).view(np.uint64), counted["n"].to_numpy(np.int64)
    order = np.argsort(heavy)
    return Idf(n, heavy[order], df[order])


def draws(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """ICWS: for each of k functions (columns) the drawn (shingle, level) of each run of equal ``doc``, as one hash."""
    first = groups(doc)
    out = np.empty((len(first), k), dtype=np.uint64)
    ends = np.append(first[1:], len(doc))
    a = 0
    while a < len(first):
        z = max(a + 1, np.searchsorted(ends, first[a] + CHUNK, side="right"))
        lo, hi = first[a], ends[z - 1]
        own, log_w = shingle[lo:hi], np.log(weight[lo:hi])
        start = first[a:z] - lo
        size = ends[a:z] - first[a:z]
        for j in range(k):
            u = mix(own + np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF))
            v = mix(u ^ np.uint64(0xD1B54A32D192ED03))
            r = -np.log(((u & np.uint64(0x3FFFFF)) + 0.5) * (((u >> np.uint64(22)) & np.uint64(0x3FFFFF)) + 0.5) * 2.0**-44)
            beta = ((u >> np.uint64(44)) + 0.5) * 2.0**-20
            c = -np.log(((v & np.uint64(0xFFFFFFFF)) + 0.5) * ((v >> np.uint64(32)) + 0.5) * 2.0**-64)
            level = np.floor(log_w / r + beta)
            log_a = np.log(c) - r * (level - beta) - r
            best = np.repeat(np.minimum.reduceat(log_a, start), size) == log_a
            at = np.flatnonzero(best)
            text = np.searchsorted(start, at, side="right") - 1
            at = at[groups(text)]
            out[a:z, j] = mix(own[at] * np.uint64(0x9E3779B97F4A7C15) + level[at].astype(np.int64).view(np.uint64))
        a = z
    return out


def _sign(idf) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text"):
                doc, s, times, count = shingles(batch.column(2))
                bands = np.zeros((batch.num_rows, BANDS), dtype=np.uint64)
                own = times * idf.value(s)
                if len(doc):
                    d = draws(doc, s, own, BANDS * ROWS)
                    rows = doc[groups(doc)]
                    for b in range(BANDS):
                        h = np.full(len(rows), b, dtype=np.uint64)
                        for r in range(ROWS):
                            h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + d[:, b * ROWS + r])
                        bands[rows, b] = h
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count.astype(np.int64)), pa.array(np.bincount(doc, own, minlength=batch.num_rows)), lists], names=["doc_id", "same", "n_words", "weight", "bands"])

    return run


def similarity(idf: Idf, a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the texts in two columns, row by row."""
    n = len(a)
    sides = []
    for side, column in ((0, a), (1, b)):
        doc, s, times, _ = shingles(column)
        sides.append((doc, s, times * idf(s), np.full(len(doc), side)))
    doc, s, weight, _ = (np.concatenate(x) for x in zip(*sides, strict=True))
    order = np.lexsort((s, doc))
    doc, s, weight = doc[order], s[order], weight[order]
    both = np.zeros(len(doc), dtype=bool)
    both[:-1] = (doc[1:] == doc[:-1]) & (s[1:] == s[:-1])
    at = np.flatnonzero(both)
    common = np.bincount(doc[at], np.minimum(weight[at], weight[at + 1]), minlength=n)
    total = np.bincount(doc, weight, minlength=n)
    return common / np.maximum(total - common, 1e-300)


def _verify(idf) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text_a", 4 << 20):
                sim = similarity(idf.value, batch.column(2), batch.column(3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], names=["a", "b", "similarity"])

    return run


def buckets(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``reps`` (rep long, weight double, bands array<long>) -> pairs a < b of the small buckets; members of the large ones."""
    keys = reps.select("rep", F.explode("bands").alias("key"))
    keys = stored(keys, "keys")
    sizes = stored(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("size", F.col("n")), "sizes")
    member = stored(keyed_join(keys, sizes, ["key"]), "buckets")
    forget(keys, sizes)
    small = member.filter(F.col("size") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("rep")).alias("of"))
    small = small.select(F.posexplode("of").alias("i", "a"), "of").select("a", F.explode(F.expr("slice(of, i + 2, size(of))")).alias("b"))
    # A node's place in the random order, from 0 to below 1, is the same in all its buckets.
    place = F.pmod(F.xxhash64("rep", F.lit(4)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    large = member.filter(F.col("size") > SMALL).join(reps, "rep").select("key", "size", "rep", "weight", "bands", place.alias("place"), _cell("rep", F.col("size")).alias("cell"))
    return small.distinct(), stored(large, "large")


def _weigh(idf) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text"):
                doc, s, times, _ = shingles(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(s.view(np.int64)), pa.array(times * idf.value(s))], names=["rep", "shingle", "own"])

    return run


def able(docs: DataFrame, large: DataFrame, idf: Idf) -> DataFrame:
    """``large`` with what each node's rarest shingles say of its similarities: shared, prefix, before. Nodes that can't reach the threshold go.

    ``shared`` is the weight of shingles that another node of ``large`` has,
    too: no similarity can use the rest. ``prefix`` are the shingles, rarest
    first, that hold just over 1 - THRESHOLD of the node's weight, without those
    that no other node has; ``before`` is the weight of all rarer ones. Two
    texts have at most in common what is left of each from their first common
    shingle on, and too little if there is none in their prefixes.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").alias("rep"), "text").join(large.select("rep").distinct().hint("merge"), "rep", "left_semi")
    each = stored(text.mapInArrow(_weigh(spark.sparkContext.broadcast(idf)), "rep long, shingle long, own double"), "weighed")
    several = stored(each.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1").withColumn("often", F.col("n")), "several")
    own = keyed_join(each, several, ["shingle"], "left").withColumn("often", F.coalesce("often", F.lit(1)))
    rarest = W.partitionBy("rep").orderBy("often", "shingle").rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("before", F.coalesce(F.sum("own").over(rarest), F.lit(0.0))).withColumn("whole", F.sum("own").over(W.partitionBy("rep")))
    start = (F.col("often") > 1) & (F.col("before") <= (1 - THRESHOLD + 1e-6) * F.col("whole"))
    per = own.groupBy("rep").agg(F.sum(F.when(F.col("often") > 1, F.col("own"))).alias("shared"), F.array_sort(F.collect_list(F.when(start, F.struct("often", "shingle", "before")))).alias("p"))
    per = per.select("rep", "shared", F.col("p.shingle").alias("prefix"), F.col("p.before").alias("before"))
    out = large.join(per.hint("merge"), "rep").filter((F.col("shared") >= (THRESHOLD - 1e-6) * F.col("weight")) & (F.size("prefix") > 0))
    out = stored(out, "able")
    forget(each, several)
    return out


def _cells(size: Column) -> Column:
    return F.ceil(size / CELL).cast("int")


def _cell(rep: str, size: Column) -> Column:
    return F.pmod(F.xxhash64(rep, F.lit(5)), _cells(size)).cast("int")


def unsettled(large: DataFrame, label: DataFrame, done: int) -> DataFrame:
    """Members, with their labels, of the large buckets that hold several components and have pairs left."""
    now = large.filter(F.col("size") > done).join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    of = now.groupBy("key", "size", "label").agg(F.count("*").alias("n")).groupBy("key", "size").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).filter("labels > 1")
    of = of.select("key", F.col("most.label").alias("main"), F.col("most.n").alias("n_main"), F.explode(F.sequence(F.lit(0), _cells(F.col("size")) - 1)).alias("cell"))
    return stored(now.join(of, ["key", "cell"]).drop("cell"), "unsettled")


def met(now: DataFrame, done: int, upto: int) -> DataFrame:
    """Pairs a < b of different components whose earlier node is the pivot of this round.

    Nodes outside a bucket's largest component meet all pivots, the others only
    pivots outside of it: that is every pair of two components, once. A pair in
    several buckets comes from the first of them alone, and a pair that can't
    reach the threshold by its shared weights or its first common shingle from none.
    """
    minor = F.col("label") != F.col("main")
    rest = F.col("size") - F.col("n_main")
    at = F.col("place") * F.col("size")
    x = now.select("key", minor.alias("minor"), _cell("rep", F.when(minor, rest).otherwise(F.col("n_main"))).alias("cell"), *(F.col(c).alias(f"x_{c}") for c in ("rep", "place", "weight", "shared", "prefix", "before", "label", "bands")))
    p = now.filter((at >= done) & (at < upto))
    p = p.select("key", F.explode(F.when(minor, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("minor"), rest.alias("rest"), "n_main", "rep", "place", "weight", "shared", "prefix", "before", "label", "bands")
    p = p.withColumn("cell", F.explode(F.sequence(F.lit(0), _cells(F.when(F.col("minor"), F.col("rest")).otherwise(F.col("n_main"))) - 1)))
    later = (F.col("x_place") > F.col("place")) | (F.col("x_place") == F.col("place")) & (F.col("x_rep") > F.col("rep"))
    common = F.least("shared", "x_shared")
    whole = F.col("weight") + F.col("x_weight")
    alike = common >= (THRESHOLD - 1e-6) * (whole - common)
    start = F.try_element_at(F.array_intersect("prefix", "x_prefix"), F.lit(1))
    left = F.least(*(F.col(f"{x}weight") - F.element_at(f"{x}before", F.array_position(f"{x}prefix", start).cast("int")) for x in ("", "x_")))
    close = start.isNotNull() & (left >= (THRESHOLD - 1e-6) * (whole - left))
    first = F.element_at(F.array_intersect("bands", "x_bands"), 1) == F.col("key")
    both = p.join(x, ["key", "minor", "cell"]).filter((F.col("label") != F.col("x_label")) & later & alike & close & first)
    return both.select(F.least("rep", "x_rep").alias("a"), F.greatest("rep", "x_rep").alias("b"))


def classes(docs: DataFrame, reps: DataFrame, idf: Idf) -> DataFrame:
    """node, label: components of all verified pairs of nodes that share a band."""
    small, large = buckets(reps)
    links = stored(verified(docs, stored(small, "pairs"), idf), "verified")
    label = components(links)
    most = large.agg(F.max("size")).first()[0] or 0
    done, upto = 0, PIVOTS
    if most:
        large = able(docs, large, idf)
    while done < most:
        now = unsettled(large, label, done)
        if not now.limit(1).count():
            break
        found = stored(verified(docs, stored(met(now, done, upto), "pairs"), idf), "verified")
        if found.limit(1).count():
            label = merged(label, found)
        done, upto = upto, upto * GROW
    return label


def verified(docs: DataFrame, pairs: DataFrame, idf: Idf, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) with their similarity where it reaches the threshold."""
    spark = docs.sparkSession
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    # Merge joins at every size: ids and pairs grow with the data, and skewed ones are split at run time.
    text = stored(docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi"), "candidates")
    a, b = (text.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")).hint("merge") for k in ("a", "b"))
    both = pairs.join(a, "a").join(b, "b")
    both = both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(spark.sparkContext.broadcast(idf)), "a long, b long, similarity double")
    return both.filter(F.col("similarity") >= threshold - 1e-9)


def minhash_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id long, text string, ...) -> doc_id, class_id, copy_of."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    idf = frequencies(texts)
    signed = texts.filter("doc_id IS NOT NULL").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("same"), "text")
    signed = stored(signed.mapInArrow(_sign(spark.sparkContext.broadcast(idf)), "doc_id long, same string, n_words long, weight double, bands array<long>"), "signed")
    reps = stored(signed.filter("n_words > 0").groupBy("same").agg(F.min(F.struct("doc_id", "n_words", "weight", "bands")).alias("r"), F.count("*").alias("n")).select("same", "n", F.col("r.doc_id").alias("rep"), F.col("r.n_words").alias("n_words"), F.col("r.weight").alias("weight"), F.col("r.bands").alias("bands")), "reps")
    label = classes(texts, reps.filter(F.col("n_words") >= SHINGLE).select("rep", "weight", "bands"), idf)
    of = reps.select("same", "n", "rep").join(label, F.col("rep") == F.col("node"), "left").select("same", "n", F.col("rep").alias("copy_of"), F.coalesce("label", "rep").alias("class_id"))
    grouped = keyed_join(signed.filter("n_words > 0").select("doc_id", "same"), stored(of, "classes"), ["same"]).select("doc_id", "class_id", "copy_of")
    alone = signed.filter("n_words = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"))
    unknown = texts.filter("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("copy_of"))
    return grouped.union(alone).union(unknown)


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return minhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
