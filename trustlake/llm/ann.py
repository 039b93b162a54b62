"""Approximate nearest neighbours: one hierarchical navigable small-world (HNSW) graph per shard.

Equal vectors are one graph node with its smallest ids (as many as an answer
can need), so a vector that a third of all rows share costs one node. Nodes go
to shards of about ``SHARD`` by a hash. A shard's graph is stored in one row as
flat arrays: vectors, and for each level its nodes and their neighbours
(``LINKS`` per node, twice that on the lowest level, -1 where there are fewer).

For inner products, vectors get one more coordinate that gives all the same
norm, so nearest by angle is largest by product. Nodes aren't inserted one by
one: a level's neighbours are chosen from the exact nearest nodes of that level
in the shard by the HNSW diversity rule and linked both ways; the rest of the
slots go to the nearest. Searches go down the levels and end with a beam of
``BEAM`` on the lowest one; they run for a block of queries at once. The nodes
found are scored exactly, in double precision on the original vectors (float or
double); shard results are merged per query.

Graphs and queries meet by shard: each block of queries goes once to each
shard, where the shard's graph comes first and stays in memory while the blocks
pass by. So a graph is shuffled once, whatever the number of queries.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components neither ask nor answer; a null id doesn't either; vectors of
different lengths don't meet; fewer candidates than k give them all (a shard of
up to the beam's width is searched whole); ties go to the smaller id; rows that
repeat an id count as one candidate for each different vector; very long
vectors make smaller graphs of no other form; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlake.llm._session import partitions, stored

SHARD = 16_384
LINKS, NEAR, BEAM = 16, 48, 224
BLOCK = 4096
SALTS = 64


def _diverse(sims: np.ndarray, ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """HNSW's choice among candidates in order of similarity: one that is nearer to the node than to any chosen one; free slots go to the nearest."""
    n, k = ids.shape
    chosen = np.full((n, most), -1, dtype=np.int32)
    count = np.zeros(n, dtype=np.int64)
    v = x[ids]
    among = np.matmul(v, v.transpose(0, 2, 1))
    picked = np.zeros((n, k), dtype=bool)
    rows = np.arange(n)
    worst = np.full((n, k), -np.inf, dtype=x.dtype)
    for c in range(k):
        take = (count < most) & (sims[:, c] > worst[:, c]) & np.isfinite(sims[:, c])
        at = rows[take]
        chosen[at, count[at]] = ids[at, c]
        count[at] += 1
        picked[at, c] = True
        worst[at] = np.maximum(worst[at], among[at, c])
    for c in range(k):
        take = (count < most) & ~picked[:, c] & np.isfinite(sims[:, c])
        at = rows[take]
        chosen[at, count[at]] = ids[at, c]
        count[at] += 1
    return chosen


def _level(x: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """Neighbours (positions in ``nodes``) of all nodes of a level."""
    v = x[nodes]
    n = len(nodes)
    k = min(NEAR, n - 1)
    if k <= 0:
        return np.full((n, most), -1, dtype=np.int32)
    half = most // 2
    out = np.full((n, half), -1, dtype=np.int32)
    step = max(1, (1 << 22) // n)
    for a in range(0, n, step):
        sims = v[a : a + step] @ v.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -np.inf
        ids = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        s = np.take_along_axis(sims, ids, axis=1)
        order = np.argsort(-s, axis=1, kind="stable")
        s, ids = np.take_along_axis(s, order, axis=1), np.take_along_axis(ids, order, axis=1)
        for b in range(0, len(ids), 512):
            out[a + b : a + min(b + 512, len(ids))] = _diverse(s[b : b + 512], ids[b : b + 512], v, half)
    # Links both ways: the other half of the slots goes to nodes that chose this one, nearest first.
    src = np.repeat(np.arange(n), half)
    dst = out.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0].astype(np.int64)
    once = ~np.isin(dst * n + src, src * n + dst)
    src, dst = src[once], dst[once]
    sim = np.einsum("ij,ij->i", v[src], v[dst])
    order = np.lexsort((-sim, dst))
    src, dst = src[order], dst[order]
    first = np.searchsorted(dst, np.arange(n))
    place = np.arange(len(dst)) - first[dst]
    back = np.full((n, most - half), -1, dtype=np.int32)
    keep = place < most - half
    back[dst[keep], place[keep]] = src[keep]
    return np.concatenate([out, back], axis=1)


def build(vectors: np.ndarray, largest: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the top down: nodes and their neighbours."""
    x = _even(vectors, largest)
    n = len(x)
    rng = np.random.default_rng(n)
    level = np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int)
    out = []
    for at in range(level.max(initial=0), -1, -1):
        nodes = np.flatnonzero(level >= at).astype(np.int32)
        near = _level(x, nodes, LINKS * (2 if at == 0 else 1))
        out.append((nodes, np.where(near >= 0, nodes[near], -1).astype(np.int32)))
    return out


def _even(vectors: np.ndarray, largest: float) -> np.ndarray:
    norm = (vectors.astype(np.float64) ** 2).sum(axis=1)
    return np.column_stack([vectors, np.sqrt(np.maximum(largest**2 - norm, 0))]).astype(np.float32)


def _beam(x: np.ndarray, place: np.ndarray, near: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> np.ndarray:
    """Best-first search of one level for all queries at once: the ids of each beam, best first, -1 where it is shorter."""
    n = len(q)
    seen = np.zeros((n, len(x)), dtype=bool)
    ids = np.full((n, width), -1, dtype=np.int64)
    sims = np.full((n, width), -np.inf, dtype=np.float32)
    done = np.ones((n, width), dtype=bool)
    rows = np.arange(n)
    ids[:, 0] = entry
    sims[:, 0] = np.einsum("ij,ij->i", x[entry], q)
    done[:, 0] = False
    seen[rows, entry] = True
    live = rows
    while len(live):
        open_sims = np.where(done[live], -np.inf, sims[live])
        best = open_sims.argmax(axis=1)
        live_now = np.isfinite(open_sims[np.arange(len(live)), best])
        live, best = live[live_now], best[live_now]
        if not len(live):
            break
        done[live, best] = True
        new = near[place[ids[live, best]]]
        fresh = (new >= 0) & ~seen[live[:, None], np.maximum(new, 0)]
        r, c = np.nonzero(fresh)
        seen[live[r], new[r, c]] = True
        s = np.full(new.shape, -np.inf, dtype=np.float32)
        s[r, c] = np.einsum("ij,ij->i", x[new[r, c]], q[live[r]])
        all_ids = np.concatenate([ids[live], new], axis=1)
        all_sims = np.concatenate([sims[live], s], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
        ids[live] = np.take_along_axis(all_ids, order, axis=1)
        sims[live] = np.take_along_axis(all_sims, order, axis=1)
        done[live] = np.take_along_axis(all_done, order, axis=1)
    return np.where(np.isfinite(sims), ids, -1)


def search(vectors: np.ndarray, largest: float, levels: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, width: int) -> np.ndarray:
    """Node ids for each query."""
    n = len(vectors)
    if n <= width:
        return np.tile(np.arange(n), (len(queries), 1))
    x = _even(vectors, largest)
    q = np.column_stack([queries, np.zeros(len(queries))]).astype(np.float32)
    out = np.empty((len(q), width), dtype=np.int64)
    step = max(16, (1 << 25) // n)
    for a in range(0, len(q), step):
        own = q[a : a + step]
        entry = np.full(len(own), levels[0][0][0])
        for k, (nodes, near) in enumerate(levels):
            place = np.zeros(n, dtype=np.int64)
            place[nodes] = np.arange(len(nodes))
            last = k == len(levels) - 1
            found = _beam(x, place, near, own, entry, width if last else 4)
            entry = found[:, 0]
        out[a : a + step] = found
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block (first columns: key, size) as one row: ids and vectors. Rows come sorted by block."""
    now, ids, vectors = None, [], []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([pickle.dumps((np.array(ids, dtype=np.int64), np.stack(vectors)))], pa.binary())], names=["block", "size", "queries"])

    for batch in batches:
        for block, size, vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if now is not None and (block, size) != now:
                yield out()
                ids, vectors = [], []
            now = (block, size)
            ids.append(vec_id)
            vectors.append(v.values.to_numpy())
    if now is not None:
        yield out()


def _graphs(largest: float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors = None, [], []

        def out() -> pa.RecordBatch:
            x = np.stack(vectors)
            # The order of rows in a shard must not matter: nodes go by their smallest id.
            order = np.argsort([i[0] for i in ids], kind="stable")
            own = [ids[k] for k in order]
            row = (x[order], own, build(x[order], largest))
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([pickle.dumps(row)], pa.binary())], names=["shard", "size", "graph"])

        for batch in batches:
            for shard, size, own, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if now is not None and (shard, size) != now:
                    yield out()
                    ids, vectors = [], []
                now = (shard, size)
                ids.append(own)
                vectors.append(v.values.to_numpy())
        if now is not None:
            yield out()

    return run


def _answers(k: int, largest: float, width: int) -> object:
    """Rows of a shard: its graph first, then blocks of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, graph = None, None
        for batch in batches:
            for shard, size, kind, body in zip(*(batch.column(c).to_pylist() for c in ("shard", "size", "kind", "body")), strict=True):
                if kind == 0:
                    now, graph = (shard, size), pickle.loads(body)
                    continue
                if now != (shard, size):
                    # No vectors of this length in the shard.
                    continue
                vectors, ids, levels = graph
                qids, q = pickle.loads(body)
                found = search(vectors, largest, levels, q, width)
                exact, q = vectors.astype(np.float64), q.astype(np.float64)
                rows = [[], [], []]
                for r, own in enumerate(found):
                    own = own[own >= 0]
                    s = exact[own] @ q[r]
                    # Ties among nodes are settled by id below; keep all nodes that reach the k-th score.
                    best = own if len(s) <= k + 1 else own[s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1]]
                    mine = sorted((-float((exact[node] * q[r]).sum()), v) for node in best for v in ids[node] if v != qids[r])[:k]
                    rows[0] += [int(qids[r])] * len(mine)
                    rows[1] += [v for _, v in mine]
                    rows[2] += [-s for s, _ in mine]
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<float> if that is its type, else array<double>), size of the rows that take part."""
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.filter(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0)).withColumn("size", F.size("v"))


def index(vectors: DataFrame, k: int) -> tuple[DataFrame, int, float]:
    """Table of shard graphs of ``usable`` rows, the number of shards, and the largest norm."""
    spark = vectors.sparkSession
    # The k + 1 smallest ids of each different vector, in two steps, so that a hot vector isn't one task's work.
    salted = W.partitionBy("v", "salt").orderBy("vec_id")
    few = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k + 1)
    nodes = few.groupBy("v").agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    nodes = stored(nodes.withColumn("size", F.size("v")), "nodes")
    n, largest = nodes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()
    shards = max(1, -(-n // SHARD))
    rows = nodes.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "size", "ids", "v")
    # A shard that a hash leaves empty has no graph; tasks get whole shards in turn.
    tasks = min(shards, 4 * partitions(spark))
    graphs = rows.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", "size").mapInArrow(_graphs(largest or 1.0), "shard int, size int, graph binary")
    return stored(graphs, "graphs"), shards, largest or 1.0


def nearest(vectors: DataFrame, is_query, k: int = 20, width: int = BEAM) -> DataFrame:
    """``vectors`` (vec_id, embedding, ...) -> query_id, rank, vec_id, score; ``is_query``: condition on vec_id."""
    own = usable(vectors)
    graphs, shards, largest = index(own, k)
    asks = stored(own.filter(is_query).dropDuplicates(["vec_id", "v"]), "asks")
    blocks = max(1, -(-asks.count() // BLOCK))
    packed = asks.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "size", "vec_id", "v").repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "size")
    packed = stored(packed.mapInArrow(_packed, "block int, size int, queries binary"), "queries")
    # The stated query set, in blocks, against every shard.
    asked = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "size", F.lit(1).alias("kind"), F.col("queries").alias("body"))
    held = graphs.select("shard", "size", F.lit(0).alias("kind"), F.col("graph").alias("body"))
    tasks = min(shards, 4 * partitions(vectors.sparkSession))
    met = held.union(asked).repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", "size", "kind")
    found = met.mapInArrow(_answers(k, largest, width), "query_id long, vec_id long, score double").distinct()
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
