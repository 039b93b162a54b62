"""The Merkle manifest against its SQL and a plain Python tree, over blocks of all sizes, and edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tests.oracle import check
from trustlake.llm import merkle

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, leaf int, at int"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text) -> str:
    fields = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if f is None else f"{len(f.encode())}:{f}" for f in fields))


def proofs(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and the siblings (left, right) of each node by level."""
    paths = [[] for _ in nodes]
    place = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(place):
            lo = p - p % 16
            paths[k].append(("".join(nodes[lo:p]), "".join(nodes[p + 1 : lo + 16])))
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        place = [p // 16 for p in place]
    return nodes[0], paths


def brute(rows):
    by_source = defaultdict(list)
    for r in rows:
        text = r["text"]
        struck = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if struck else text
        leaf, other = (leaf_of(r["doc_id"], r["source"], r["lang"], r["n_chars"], t) for t in (text, low))
        by_source[(r["source"] is not None, (r["source"] or "").encode())].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, other))
    keys = sorted(by_source)
    trees = [proofs([x[2] for x in sorted(by_source[k])]) for k in keys]
    root, tops = proofs([t[0] for t in trees]) if trees else (None, [])
    out = []
    for key, (subroot, paths), top in zip(keys, trees, tops):
        for (known, doc_id, leaf, other), path in zip(sorted(by_source[key]), paths):
            whole = path + top
            folded = other
            for left, right in whole:
                folded = sha(left + folded + right)
            out.append((doc_id if known else None, leaf, subroot, root, sha("".join(x + y for x, y in whole)), folded, folded == root))
    return sorted(out, key=str)


def compare(docs, block=merkle.BLOCK):
    got = [tuple(r) for r in merkle.manifest(docs, block=block).collect()]
    assert sorted(got, key=str) == brute([r.asDict() for r in docs.collect()])


def test_sql(spark):
    check(merkle.op12_merkle(spark, SF), merkle.ORACLE, SF)


@pytest.mark.parametrize("block", [3, 16, 50])
def test_blocks_of_any_size(spark, block):
    rng = random.Random(block)
    sizes = {"a": 1, "b": 16, "c": 17, "d": 300, "B": 5, None: 33, "": 2, "é": 40}
    rows = [(k * 3 + rng.randrange(3), f"Text {k} of {s}", "en", s, k, "k", 0, 0) for s, n in sizes.items() for k in range(n)]
    rng.shuffle(rows)
    compare(spark.createDataFrame(rows, DOCS).repartition(5), block)


def test_odd_rows(spark):
    rows = [(1, "Aa", "en", "s", 2), (1, "Bb", None, "s", None), (1, "Bb", None, "s", None), (None, "X", "en", "s", 1), (None, None, None, None, None), (5, "", "", "", 0), (6, "É ñ", "es", "s", 3), (8, "Word " * 30000, "en", "t", 1)]
    compare(spark.createDataFrame([(*r, "k", 0, 0) for r in rows], DOCS).repartition(3))


def test_small_tables(spark):
    one = [(5, "One", "en", "s", 3, "k", 0, 0)]
    compare(spark.createDataFrame(one, DOCS))
    compare(spark.createDataFrame(one * 20, DOCS))
    compare(spark.createDataFrame([], DOCS))


def test_a_source_in_each_row(spark):
    compare(spark.createDataFrame([(k, f"T{k}", "en", f"s{k}", 1, "k", 0, 0) for k in range(300)], DOCS).repartition(4))


def test_missing_coordinates_are_the_least():
    for n, a, b in ((300, 17, 40), (16, 0, 16), (1, 0, 1), (5000, 250, 260)):
        known = {(0, at) for at in range(a, b)} | set(merkle.missing(a, b, n))
        assert len(known) == b - a + len(list(merkle.missing(a, b, n)))
        for level in range(merkle.depth(n)):
            for p in range(a // 16 ** (level + 1), (b - 1) // 16 ** (level + 1) + 1):
                assert {(level, c) for c in range(p * 16, min(p * 16 + 16, merkle.size_at(n, level)))} <= known
                known.add((level + 1, p))
