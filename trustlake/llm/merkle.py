"""Merkle manifest of a dataset: a tree of 16 for each source, a tree of sources above, and octopus multiproofs.

Leaves are hashed by Spark's functions where the texts are; from there on only
digests move. They are put in order of (source, doc_id) by one range exchange
and written as *blocks*: up to ``BLOCK`` consecutive leaves of one source in a
row. Adding up the blocks' sizes gives each block its place in the tree.

Building: a block hashes every node that its leaves cover and hands on only
those whose parent reaches beyond it, at most 30 a level; Spark joins these,
level by level, sixteen a group, up to the subroots and the root.

Proving: a block works out the smallest set of node coordinates that its
leaves' proofs lack (octopus multiproof: siblings outside its range, level by
level), one join fetches them all at once, shared interiors are derived once,
and each leaf's proof is expanded and folded from them.

Edge cases: nulls in any column are hashed as ``-`` and a null source is a
source that comes first; a null doc_id comes first in its source and is never
tampered with; rows that repeat a doc_id are leaves of their own, in order of
their digests (equal rows have equal digests, but proofs by place); an empty
text counts 0 bytes; very long texts pass Spark's hash once and no Python; a
source of one row is its own subroot, and one source's subroot is the root;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trustlake.llm._session import keyed_join, numbered, partitions, stored

FAN = 16
#: Leaves of a block: a power of FAN keeps a block's edges few; 4,096 leaves are about 0.2 MB.
BLOCK = 4096
#: Leaves of a range of the exchange, at most on average.
RANGE = 1 << 18
#: The tree of the sources' subroots.
TOP = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
PLACE = "tree long, at_first long, total long, sources long"


def digest(values: dict[str, Column]) -> Column:
    """Leaf of a row: SHA-256 of its fields, each with its length in bytes in front."""
    each = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (values[f].cast("string") for f in FIELDS)]
    return F.unhex(F.sha2(F.concat(*each).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """key (in order of sources, null first), doc_id, leaf, and ``other``: the leaf of the tampered row, null where nobody tampers."""
    fields = {f: F.col(f) for f in FIELDS}
    changed = fields | {"text": F.translate("text", UPPER, LOWER)}
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select(
        F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit(""))).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(fields).alias("leaf"),
        F.when(struck, digest(changed)).alias("other"),
        # Equal rows may be dealt apart.
        F.monotonically_increasing_id().alias("tie"),
    )


def depth(n: int) -> int:
    """Levels from n nodes to one."""
    d = 0
    while n > 1:
        n, d = -(-n // FAN), d + 1
    return d


def size_at(n: int, level: int) -> int:
    return -(-n // FAN**level)


def _hash(parts: list[bytes]) -> bytes:
    """Digests as hex text, concatenated, to a digest as hex text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def complete(a: int, b: int, n: int, level: int) -> tuple[int, int]:
    """Nodes of a level (from, to) that the leaves a to b of n cover whole."""
    width = FAN**level
    lo = -(-a // width)
    return lo, max(lo, -(-n // width) if b == n else b // width)


def missing(a: int, b: int, n: int) -> Iterator[tuple[int, int]]:
    """(level, at) of the nodes that the proofs of leaves a to b lack: siblings of their paths without any leaf of theirs."""
    for level in range(depth(n)):
        width = FAN**level
        first, last = a // width, (b - 1) // width
        yield from ((level, at) for at in range(first - first % FAN, first))
        yield from ((level, at) for at in range(last + 1, min(last - last % FAN + FAN, size_at(n, level))))


def _blocks(most: int):
    """Rows in order -> rows (key, part, seq, leaves, doc_ids, leaf, other) of up to ``most`` leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        key, held, count = None, [], 0

        def out() -> pa.RecordBatch:
            nonlocal held, count, seq
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, leaf, other = (whole.column(c).combine_chunks() for c in ("doc_id", "leaf", "other"))
            values = [key, part, seq, count, ids.to_pylist(), leaf.to_pylist(), other.to_pylist()]
            held, count, seq = [], 0, seq + 1
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["key", "part", "seq", "leaves", "doc_ids", "leaf", "other"])

        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            codes = keys.indices.to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]]) if len(codes) else []
            for lo, hi in zip(edges[:-1], edges[1:]):
                own = keys.dictionary[codes[lo]].as_py()
                if held and own != key:
                    yield out()
                key = own
                while lo < hi:
                    step = min(hi - lo, most - count)
                    held.append(batch.slice(lo, step))
                    count, lo = count + step, lo + step
                    if count == most:
                        yield out()
        if held:
            yield out()

    return run


def blocks(docs: DataFrame, most: int = BLOCK) -> DataFrame:
    """Stored table of blocks in order of (part, seq), each of one source."""
    rows = stored(leaves(docs), "leaves")
    n = max(partitions(docs.sparkSession), -(-rows.count() // RANGE))
    order = ("key", "doc_id", "leaf", "tie")
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "doc_id", "leaf", "other")
    return stored(dealt.mapInArrow(_blocks(most), "key string, part int, seq int, leaves int, doc_ids array<long>, leaf array<binary>, other array<binary>"), "blocks")


def placed(table: DataFrame) -> tuple[DataFrame, int, int]:
    """part, seq, tree, at_first, total, sources of each block (a source's blocks pass one window), the largest source and the number of sources."""
    where = table.select("key", "part", "seq", "leaves")
    sources = stored(numbered(where.groupBy("key").agg(F.sum("leaves").alias("total"), F.count("*").alias("n")), "key").withColumnRenamed("at", "tree"), "sources")
    largest, count = sources.agg(F.coalesce(F.max("total"), F.lit(0)), F.count("*")).first()
    before = W.partitionBy("key").orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    where = where.withColumn("at_first", F.coalesce(F.sum("leaves").over(before), F.lit(0)))
    at = keyed_join(where, sources, ["key"]).select("part", "seq", "tree", "at_first", "total", F.lit(count).cast("long").alias("sources"))
    return stored(at, "places"), largest, count


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that a block covers whole without their parent."""
    for batch in batches:
        out = [[], [], [], [], []]
        for row in batch.to_pylist():
            a, n = row["at_first"], row["total"]
            b, top = a + len(row["leaf"]), depth(row["total"])
            here = [x.hex().encode() for x in row["leaf"]]
            lo, hi = a, b
            for level in range(top + 1):
                up, to = complete(a, b, n, level + 1) if level < top else (0, 0)
                inner = range(up * FAN, min(to * FAN, hi)) if to > up else range(0)
                for at in range(lo, hi):
                    if at not in inner:
                        for column, value in zip(out, (row["tree"], level, at, here[at - lo], top)):
                            column.append(value)
                if to <= up:
                    break
                here = [_hash(here[p * FAN - lo : p * FAN + FAN - lo]) for p in range(up, to)]
                lo, hi = up, to
        types = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c if t != pa.string() else [h.decode() for h in c], t) for c, t in zip(out, types)], names=["tree", "level", "at", "hash", "depth"])


def _grown(nodes: DataFrame, top: int) -> DataFrame:
    """``nodes`` with all above them, a stored level at a time. Groups have up to 16 rows."""
    known = nodes
    here = nodes.filter("level = 0")
    for level in range(top):
        run = F.array_sort(F.collect_list(F.struct("at", "hash")))
        parents = here.filter(F.col("depth") > level).groupBy("tree", "depth", F.floor(F.col("at") / FAN).alias("up")).agg(run.alias("run"))
        hashed = F.sha2(F.concat_ws("", F.transform("run", lambda r: r["hash"])).cast("binary"), 256)
        parents = stored(parents.select("tree", F.lit(level + 1).alias("level"), F.col("up").alias("at"), hashed.alias("hash"), "depth"), "level")
        known = known.unionByName(parents)
        here = nodes.filter(F.col("level") == level + 1).unionByName(parents)
    return known


def tree(table: DataFrame, places: DataFrame, largest: int, count: int) -> DataFrame:
    """tree, level, at, hash, depth of all nodes that no block covers with their parent; the tree ``TOP`` has the sources' subroots as leaves."""
    edges = stored(table.drop("key", "doc_ids", "other").join(places, ["part", "seq"]).mapInArrow(_edges, "tree long, level int, at long, hash string, depth int"), "edges")
    own = _grown(edges, depth(largest))
    subroots = own.filter("level = depth").select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("at"), "hash", F.lit(depth(count)).alias("depth"))
    return own.unionByName(_grown(stored(subroots, "subroots"), depth(count)))


def _lacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coordinates that a block lacks, in its source's tree and in that of the subroots."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            out += [(r["part"], r["seq"], r["tree"], *c) for c in missing(r["at_first"], r["at_first"] + r["leaves"], r["total"])]
            out += [(r["part"], r["seq"], TOP, *c) for c in missing(r["tree"], r["tree"] + 1, r["sources"])]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=["part", "seq", "tree", "level", "at"])


class _Tree:
    """The nodes over leaves a to b of n that their proofs need: own, fetched and derived ones."""

    def __init__(self, a: int, own: list[bytes], n: int, fetched: dict[tuple[int, int], bytes]):
        self.n, self.depth = n, depth(n)
        self.levels = [dict(enumerate(own, a))]
        first, last = a, a + len(own) - 1
        for level in range(self.depth):
            here = self.levels[level]
            here.update({at: h for (of, at), h in fetched.items() if of == level})
            first, last = first // FAN, last // FAN
            self.levels.append({p: _hash([here[c] for c in self.run(level, p)]) for p in range(first, last + 1)})
        self.root = self.levels[self.depth][0]
        self.above = [{} for _ in self.levels]

    def run(self, level: int, parent: int) -> range:
        return range(parent * FAN, min(parent * FAN + FAN, size_at(self.n, level)))

    def sides(self, level: int, at: int) -> tuple[bytes, bytes]:
        """Siblings to the left and to the right."""
        here, run = self.levels[level], self.run(level, at // FAN)
        return b"".join(here[c] for c in range(run.start, at)), b"".join(here[c] for c in range(at + 1, run.stop))

    def path(self, level: int, at: int) -> list[tuple[bytes, bytes]]:
        """Siblings from a node to the root; paths of inner nodes are shared by all leaves below."""
        if level == self.depth:
            return []
        known = self.above[level]
        if at not in known:
            known[at] = [self.sides(level, at), *self.path(level + 1, at // FAN)]
        return known[at]


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        leaf = _hash([left, leaf, right])
    return leaf


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            nodes = {(f["tree"], f["level"], f["at"]): f["hash"].encode() for f in row["fetched"] or []}
            own = [x.hex().encode() for x in row["leaf"]]
            mine = _Tree(row["at_first"], own, row["total"], {(lv, at): h for (t, lv, at), h in nodes.items() if t != TOP})
            top = _Tree(row["tree"], [mine.root], row["sources"], {(lv, at): h for (t, lv, at), h in nodes.items() if t == TOP})
            beyond = top.path(0, row["tree"])
            proof, folded = [], []
            for at, (leaf, other) in enumerate(zip(own, row["other"]), row["at_first"]):
                path = [*([mine.sides(0, at), *mine.path(1, at // FAN)] if mine.depth else []), *beyond]
                proof.append(_hash([side for sides in path for side in sides]).decode())
                folded.append(fold(leaf if other is None else other.hex().encode(), path).decode())
            root, rows = top.root.decode(), len(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array([x.decode() for x in own]),
                    pa.array([mine.root.decode()] * rows),
                    pa.array([root] * rows),
                    pa.array(proof),
                    pa.array(folded),
                    pa.array([f == root for f in folded]),
                ],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )


def manifest(docs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars, ...) -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    table = blocks(docs, block)
    places, largest, count = placed(table)
    nodes = tree(table, places, largest, count)
    sizes = table.select("part", "seq", "leaves")
    coordinate = ["tree", "level", "at"]
    lacks = stored(places.join(sizes, ["part", "seq"]).mapInArrow(_lacks, "part int, seq int, tree long, level int, at long"), "lacks")
    # A node near the root is asked for by very many blocks.
    facts = stored(lacks.groupBy(*coordinate).agg(F.count("*").alias("n")).join(nodes.select(*coordinate, "hash"), coordinate), "asked")
    fetched = keyed_join(lacks, facts, coordinate).groupBy("part", "seq").agg(F.collect_list(F.struct(*coordinate, "hash")).alias("fetched"))
    jobs = stored(places.join(fetched, ["part", "seq"], "left"), "jobs")
    return table.drop("key", "leaves").join(jobs, ["part", "seq"]).mapInArrow(_proofs, RESULT)


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


def _sql(below: int = 6, above: int = 4) -> str:
    """Levels one by one; a level of one node repeats it. ``below`` and ``above``: levels of a source's and of the subroots' tree."""
    fields = {f: _field(f) for f in FIELDS}
    changed = fields | {"text": _field(f"translate(text, '{UPPER}', '{LOWER}')")}
    steps = [
        "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t)",
        "ids AS (SELECT *, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS key, CAST(doc_id AS VARCHAR) AS d FROM documents)",
        "struck AS (SELECT *, coalesce(xor(list_reduce(range(1, len(d) + 1), lambda c, i: xor(c >> 8, t[(xor(c, ascii(d[i])) & 255) + 1]), 4294967295), 4294967295) % 5 = 0, false) AS hit FROM ids, crc)",
        f"made AS (SELECT doc_id, key, sha256({' || '.join(fields.values())}) AS leaf, CASE WHEN hit THEN sha256({' || '.join(changed.values())}) END AS other FROM struck)",
        "base AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM made)",
        "a0 AS (SELECT key, pos, leaf AS h FROM base)",
    ]

    def climb(name: str, levels: int) -> None:
        for k in range(levels):
            steps.append(f"{name}r{k} AS (SELECT *, count(*) OVER (PARTITION BY key) AS n, string_agg(h, '') OVER (PARTITION BY key, pos // {FAN} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run FROM {name}{k})")
            steps.append(f"{name}s{k} AS (SELECT key, pos, n, left(run, 64 * (pos % {FAN})) AS l, substr(run, 64 * (pos % {FAN}) + 65) AS r FROM {name}r{k})")
            steps.append(f"{name}{k + 1} AS (SELECT key, pos // {FAN} AS pos, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(max(run)) END AS h FROM {name}r{k} GROUP BY key, pos // {FAN})")

    climb("a", below)
    steps.append(f"b0 AS (SELECT 0 AS key, row_number() OVER (ORDER BY key) - 1 AS pos, h, key AS of FROM a{below})")
    steps.append("ord AS (SELECT of AS key, pos AS top, h AS subroot FROM b0)")
    climb("b", above)
    steps.append(f"f0 AS (SELECT doc_id, leaf, key, pos, top, subroot, (SELECT h FROM b{above}) AS root, '' AS proof, coalesce(other, leaf) AS f FROM base JOIN ord USING (key))")
    last = 0
    for name, levels, pos, key in (("a", below, "pos", "s.key = f.key AND"), ("b", above, "top", "")):
        for k in range(levels):
            fold_ = "CASE WHEN s.n = 1 THEN f.f ELSE sha256(s.l || f.f || s.r) END AS f"
            steps.append(f"f{last + 1} AS (SELECT f.* EXCLUDE (proof, f), f.proof || s.l || s.r AS proof, {fold_} FROM f{last} f JOIN {name}s{k} s ON {key} s.pos = f.{pos} // {FAN**k})")
            last += 1
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{last}"


ORACLE = _sql()
