"""Packing: token ids against the tokenizer on whole texts, the plan against bounds and exact packings, whole results by brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from trustlake.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, piece string, length string, bucket int"


def ids_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


@lru_cache(1)
def tokenizer():
    return packing.Ids(PATH).tokenizer


def check(rows, docs, length=2048):
    """Every document whole, pieces cut from the end, sequences gapless. Returns the number of sequences."""
    expected = Counter()
    for doc_id, text in docs:
        ids = ids_of(text)
        first = (len(ids) - 1) % length + 1
        cuts = [0, *range(first, len(ids) + 1, length)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            expected[(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
    return len(sequences)


def test_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = packing.op13_packing(spark, SF).collect()
    used = check(rows, docs)
    assert used == packing.plan(Counter(r.length for r in rows))[1]


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "same"), (4, "same"), (4, "same"), (4, "other text"), (None, "no id"), (None, None), (5, "word " * 30000), (6, "x" * 20000), (7, " \t\n ")]
    df = spark.createDataFrame([(i, t, "p", "l", 1) for i, t in docs], DOCS).repartition(3)
    check(packing.pack(df, PATH).collect(), docs)
    check(packing.pack(df, PATH, length=7).collect(), docs, 7)
    assert packing.pack(df.limit(0), PATH).collect() == []


def test_ids_by_chunks_are_those_of_whole_texts():
    rng = random.Random(7)
    some = [*" \t\n\r\x0b\x0c", " ", "a", "B", "9", "é", "ß", "×", "'", "’", "-", ".", ",", "<|", " ", " ", "　", "\x1c", "\x85", "中", "🙂", "́", "'s", "'ll", " the", "<|endoftext|>"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(30))) for _ in range(5000)]
    for path in (PATH, public_tokenizers.path("word_bpe_49k.json")):
        ids = packing.Ids(path)
        assert [i.tolist() for i in ids(pa.array(texts))] == [e.ids for e in ids.tokenizer.encode_batch(texts, add_special_tokens=False)]


def total(slots):
    return sum(s.times for s in slots)


def valid(slots, counts, length):
    places = Counter()
    for s in slots:
        assert sum(size * n for size, n in s.parts.items()) <= length
        for size, n in s.parts.items():
            places[size] += n * s.times
    assert places == Counter({s: n for s, n in counts.items() if n})


@lru_cache(None)
def fewest(left: tuple, length: int) -> int:
    """Exact number of sequences by search (first piece with every subset that fits)."""
    if not left:
        return 0
    best = len(left)
    others = left[1:]
    for mask in range(1 << len(others)):
        if left[0] + sum(s for k, s in enumerate(others) if mask >> k & 1) <= length:
            best = min(best, 1 + fewest(tuple(s for k, s in enumerate(others) if not mask >> k & 1), length))
    return best


def test_small_plans_against_search():
    rng = random.Random(8)
    for _ in range(25):
        sizes = sorted((rng.randrange(1, 21) for _ in range(8)), reverse=True)
        counts = dict(Counter(sizes))
        slots, bound = packing.plan(counts, 20)
        valid(slots, counts, 20)
        exact = fewest(tuple(sizes), 20)
        assert bound <= exact <= total(slots) <= exact + 1


def test_perfect_triples():
    """Triples that fill sequences wholly, where best fit loses 7 %."""
    rng = random.Random(9)
    counts = Counter()
    for _ in range(3000):
        a = rng.randrange(778, 1003)
        b = rng.randrange((2048 - a) // 2 - 150, (2048 - a) // 2)
        counts.update((a, b, 2048 - a - b))
    slots, bound = packing.plan(counts)
    valid(slots, counts, 2048)
    assert bound == 3000 and total(slots) <= 3015 < total(packing.best_fit(counts, 2048))


def test_plans_of_any_form():
    rng = random.Random(10)
    for counts in ({}, {2048: 5}, {1: 10**9}, {1: 1}, {2047: 3, 1: 2}, {700: 10**9, 800: 10**9, 40: 3}, {s: rng.randrange(50) for s in range(1, 300)}):
        slots, bound = packing.plan(counts)
        valid(slots, counts, 2048)
        assert bound <= total(slots) <= 1.02 * bound + 1
