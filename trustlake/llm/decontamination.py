"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are cut into lower-case tokens (ASCII
punctuation separates). A document and an item that share a run of ``SEED``
tokens form a candidate pair. Each pair is tiled: running Karp-Rabin hashes
find the longest match of unmarked tokens, which is marked as a tile, until no
match of ``SEED`` tokens is left; what hashes find is compared token by token. As tiles may come in any order, reordered
passages count in full. A pair is contaminated when tiles cover at least
``COVERAGE`` of the item's tokens.

Items shorter than ``SEED`` tokens use their whole length as seed. The seed
table is broadcast only up to ``MOST_SEEDS`` hashes (a benchmark is small);
larger ones meet the documents' hashes in a join, with the same result.

Result: one row per contaminated pair: doc_id, item_id, item_tokens,
covered_tokens, n_tiles, coverage. Edge cases: null or tokenless texts and
items give no row; null ids can't be reported and give none; items with the
same text each give a row; repeated rows give equal rows (with the join path
one for each text of a doc_id); very long and repetitive texts are tiled whole,
at a cost of a few passes for each length of tiles; an empty table on either
side gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm._session import keyed_join, stored
from trustlake.llm._words import inside, mix, parts, windows, words

SEED, COVERAGE = 5, 0.5
MOST_SEEDS = 500_000
BASE = np.uint64(0x9FB21C651E98DF25)
RESULT = "doc_id long, item_id long, item_tokens long, covered_tokens long, n_tiles long, coverage double"


def _prints(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin sums of all prefixes and the powers of the base, modulo 2^64."""
    with np.errstate(over="ignore"):
        powers = np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(len(tokens), BASE, dtype=np.uint64), dtype=np.uint64)])
        return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(tokens) * powers[:-1], dtype=np.uint64)]), powers


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token arrays by running Karp-Rabin: (item position, document position, length), longest first.

    The search length falls from the longest match on: once no unmarked match
    of a length is left, the next shorter one is found by halving, as a match
    holds all shorter ones. Prefix sums give each window's hash at once, so a
    length costs a few passes over the tokens, and there are at most
    sqrt(2 x item) different lengths of tiles. Of equal windows, document
    positions go in order, each with the first item position that is free.
    """
    item, doc = np.asarray(item).astype(np.uint64), np.asarray(doc).astype(np.uint64)
    (sum_a, of_a), (sum_b, of_b) = _prints(item), _prints(doc)
    powers = of_a if len(item) > len(doc) else of_b
    free_a, free_b = np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool)
    found: list[tuple[int, int, int]] = []

    def room(free: np.ndarray) -> np.ndarray:
        """Unmarked tokens from each position on."""
        at = np.where(free, len(free), np.arange(len(free)))
        return np.minimum.accumulate(at[::-1])[::-1] - np.arange(len(free))

    def windows_of(sums: np.ndarray, space: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(space >= size)
        # Hashes are brought to one power of the base, so that equal windows agree wherever they start.
        return (sums[start + size] - sums[start]) * powers[len(powers) - 1 - start], start

    def shared(size: int) -> bool:
        return bool(np.isin(windows_of(sum_a, room_a, size)[0], windows_of(sum_b, room_b, size)[0]).any())

    size = min(len(item), len(doc)) + 1
    with np.errstate(over="ignore"):
        while True:
            room_a, room_b = room(free_a), room(free_b)
            low, high = least - 1, size - 1
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if shared(mid) else (low, mid - 1)
            size = low
            if size < least:
                return found
            h_a, start_a = windows_of(sum_a, room_a, size)
            h_b, start_b = windows_of(sum_b, room_b, size)
            order = np.argsort(h_a, kind="stable")
            h_a, start_a = h_a[order], start_a[order]
            hit = np.flatnonzero(np.isin(h_b, h_a))
            first, last = np.searchsorted(h_a, h_b[hit]), np.searchsorted(h_a, h_b[hit], side="right")
            # Item windows that overlap a tile stay so: each list of equal windows is walked once.
            next_of: dict[int, int] = {}
            until = -1
            for j, a, z in zip(start_b[hit].tolist(), first.tolist(), last.tolist(), strict=True):
                if j < until:
                    continue
                k = next_of.get(a, a)
                while k < z and not (free_a[start_a[k]] and free_a[start_a[k] + size - 1] and np.array_equal(item[start_a[k] : start_a[k] + size], doc[j : j + size])):
                    k += 1
                next_of[a] = k
                if k < z:
                    i = int(start_a[k])
                    free_a[i : i + size] = free_b[j : j + size] = False
                    found.append((i, j, size))
                    until = j + size


def _row(doc_id: int, item_id: int, item: np.ndarray, doc: np.ndarray, coverage: float) -> tuple | None:
    found = tiles(item, doc, min(SEED, len(item)))
    covered = sum(n for _, _, n in found)
    return (doc_id, item_id, len(item), covered, len(found), covered / len(item)) if covered >= coverage * len(item) else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.float64()], strict=True)], names=["doc_id", "item_id", "item_tokens", "covered_tokens", "n_tiles", "coverage"])


def _broadcast_join(shared, coverage: float) -> object:
    """Documents against a broadcast benchmark: seeds by binary search, then tiles for the items that share any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, owner, sizes, items, ids = shared.value
        for whole in batches:
            for batch in parts(whole, "text"):
                doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
                w = words(batch.column(1), lower=True, punctuation=True)
                shares: dict[tuple[int, int], set[int]] = defaultdict(set)
                for size in sizes:
                    at = inside(w, size)
                    h = windows(w, size)[at]
                    lo = np.searchsorted(seeds, h)
                    hit = np.flatnonzero(seeds[np.minimum(lo, len(seeds) - 1)] == h)
                    doc = np.searchsorted(w.first, at[hit], side="right") - 1
                    for d, first, start in zip(doc, lo[hit], at[hit], strict=True):
                        k = first
                        while k < len(seeds) and seeds[k] == seeds[first]:
                            shares[d, int(owner[k])].add(int(start - w.first[d]))
                            k += 1
                rows = []
                for (d, k), where in shares.items():
                    row = _row(int(doc_ids[d]), int(ids[k]), items[k], _kept(w, d, np.array(sorted(where)), min(SEED, len(items[k]))), coverage)
                    if row:
                        rows.append(row)
                yield _batch(rows)

    return run


def _kept(w, d: int, starts: np.ndarray, size: int) -> np.ndarray:
    """The document's tokens that a shared seed covers, one gap between pieces: no tile reaches outside them."""
    out = []
    edges = np.concatenate([[0], np.flatnonzero(np.diff(starts) > size) + 1, [len(starts)]])
    for k, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        out += [w.hash[w.first[d] + starts[a] : w.first[d] + starts[z - 1] + size], np.array([k], dtype=np.uint64)]
    return np.concatenate(out)


def _benchmark(items: DataFrame) -> tuple:
    """Broadcast form of a bounded benchmark."""
    rows = items.select("item_id", "text").toPandas()
    w = words(pa.array(rows["text"], pa.string()), lower=True, punctuation=True)
    tokens = [w.hash[w.first[k] : w.first[k + 1]] for k in range(len(rows))]
    h, owner = [], []
    for size in sorted({min(SEED, len(t)) for t in tokens if len(t)}):
        at = inside(w, size)
        k = np.searchsorted(w.first, at, side="right") - 1
        keep = np.minimum(w.count[k], SEED) == size
        h.append(windows(w, size)[at][keep])
        owner.append(k[keep])
    h = np.concatenate(h) if h else np.zeros(0, dtype=np.uint64)
    owner = np.concatenate(owner) if owner else np.zeros(0, dtype=np.int64)
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new], sorted({min(SEED, len(t)) for t in tokens if len(t)}), tokens, rows["item_id"].to_numpy()


def _hashes(sizes: list[int]) -> object:
    """Distinct (id, seed length, seed hash) of each text; with no ``sizes`` (items) only those of the text's own seed length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text"):
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                w = words(batch.column(1), lower=True, punctuation=True)
                for size in sizes or range(1, SEED + 1):
                    at = inside(w, size)
                    doc = np.searchsorted(w.first, at, side="right") - 1
                    h = windows(w, size)[at]
                    if not sizes:
                        keep = np.minimum(w.count[doc], SEED) == size
                        doc, h = doc[keep], h[keep]
                    order = np.lexsort((h, doc))
                    doc, h = doc[order], h[order]
                    new = np.ones(len(h), dtype=bool)
                    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[doc[new]]), pa.array(np.full(int(new.sum()), size, dtype=np.int32)), pa.array(h[new].view(np.int64))], names=["id", "size", "seed"])

    return run


def _tile_pairs(coverage: float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text"):
                d = words(batch.column(1), lower=True, punctuation=True)
                i = words(batch.column(3), lower=True, punctuation=True)
                rows = []
                for k, (doc_id, item_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    row = _row(doc_id, item_id, i.hash[i.first[k] : i.first[k + 1]], d.hash[d.first[k] : d.first[k + 1]], coverage)
                    if row:
                        rows.append(row)
                yield _batch(rows)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE, most_seeds: int = MOST_SEEDS) -> DataFrame:
    """``docs`` (doc_id, text, ...) and ``benchmark`` (item_id, text, ...) -> contaminated pairs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    # A text of n bytes has at most n / 2 + 1 tokens, and no more seeds.
    if (items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0) <= most_seeds:
        bench = _benchmark(items)
        if not len(bench[0]):
            return spark.createDataFrame([], RESULT)
        return docs.mapInArrow(_broadcast_join(spark.sparkContext.broadcast(bench), coverage), RESULT)
    # Items pass hashes of their own seed length, documents those of the lengths that occur.
    seeds = stored(items.mapInArrow(_hashes([]), "id long, size int, seed long").withColumnRenamed("id", "item_id"), "seeds")
    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())
    if not sizes:
        return spark.createDataFrame([], RESULT)
    # Seeds that very many documents have are few, and broadcast; the others meet by merge.
    own = stored(docs.mapInArrow(_hashes(sizes), "id long, size int, seed long").withColumnRenamed("id", "doc_id").join(seeds.select("size", "seed").distinct().hint("merge"), ["size", "seed"], "left_semi"), "hits")
    often = stored(own.groupBy("size", "seed").agg(F.count("*").alias("n")).join(seeds.hint("merge"), ["size", "seed"]).groupBy("size", "seed").agg(F.first("n").alias("n"), F.collect_set("item_id").alias("items")), "items-of")
    pairs = stored(keyed_join(own, often, ["size", "seed"]).select("doc_id", F.explode("items").alias("item_id")).distinct(), "pairs")
    both = pairs.join(docs.hint("merge"), "doc_id").join(items.select("item_id", F.col("text").alias("item_text")).hint("merge"), "item_id")
    return both.select("doc_id", "text", "item_id", "item_text").mapInArrow(_tile_pairs(coverage), RESULT)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
