"""Counts of a corpus for what is asked: against plain Python, over windows and buckets, and what they leave on disk."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow as pa
import pytest

from tests.test_context_model import TEXTS
from trustlake.operators import context_model as K
from trustlake.operators import corpus_counts as CC
from trustlake.operators import mining
from trustlake.plans import catalogue

SF = "/root/testdata/sf0.001"


def written(spark) -> int:
    """Bytes in the shared folder."""
    return sum(p.stat().st_size for p in Path(spark.conf.get("spark.checkpoint.dir")).rglob("*.parquet"))


def brute(texts):
    three, two, after = Counter(), Counter(), set()
    for t in texts:
        s = ["^", "^", *re.findall("[a-z']+", (t or "").lower()), "$", "$"]
        three.update(zip(s, s[1:], s[2:]))
        two.update(zip(s, s[1:]))
        after |= set(zip(s[1:-1], s[2:-1]))
    return three, two, after


@pytest.mark.parametrize("window", [8, 1 << 21])
def test_counts_over_windows_and_buckets(monkeypatch, window):
    monkeypatch.setattr(CC, "WINDOW", window)
    texts = [*TEXTS, "the good " * 9, "rare", "a b c d e f g h i j k l m n o p q r s t", "the bad film"]
    three, two, after = brute(texts)
    asked = CC.Asked(sorted({w for t in three for w in t} | {"absent"}), [*two, ("absent", "the"), ("the", "absent")], [*three, ("the", "absent", "the")])
    marked = [" ".join(["^ ^", *re.findall("[a-z']+", (t or "").lower()), "$ $"]) for t in texts]
    kinds = frozenset({"words", "pairs", "triples"})
    sent = []
    for part in (marked[::2], marked[1::2]):
        batches = [pa.RecordBatch.from_arrays([pa.array(part[k : k + 3])], names=["t"]) for k in range(0, len(part), 3)]
        sent += [r for b in CC._sender(asked, kinds, 4)(iter(batches)) for r in b.to_pylist()]
    assert len({r["bucket"] for r in sent}) == 4
    table = pa.Table.from_pylist(sorted(sent, key=lambda r: r["bucket"]), schema=CC._rows([]).schema)
    got = defaultdict(int)
    for b in CC._receiver(asked)(iter(table.to_batches(max_chunksize=5))):
        for r in b.to_pylist():
            got[r["kind"], r["id"]] += r["n"]
    words = {w for p in two for w in p} - {"^", "$"}
    assert (got["texts", 0], got["words", 0], got["pairs", 0]) == (len(texts), len(words), len(after))
    for k, w in enumerate(asked.words):
        assert got["left", k] == len({x for x, y in after if y == w}) and got["right", k] == len({y for x, y in after if x == w})
        assert got["around", k] == len({(x, z) for x, y, z in three if y == w})
        assert got["n1", k] == sum(n for (x, y), n in two.items() if x == w and (x, y) in after)
    for k, p in enumerate(asked.pairs):
        assert got["n2", k] == two[p] and got["starts", k] == len({x for x, *yz in three if tuple(yz) == p}) and got["ends", k] == len({z for *xy, z in three if tuple(xy) == p})
    for k, t in enumerate(asked.triples):
        assert got["n3", k] == three[t]


@pytest.mark.parametrize("discount", [0.75, 0.4])
def test_same_likelihood_as_the_whole_model(spark, monkeypatch, discount):
    corpus = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    new = spark.createDataFrame([(1, "the good rare film"), (2, ""), (3, None), (4, "Film"), (5, "new newer the good end of the film")], "doc_id long, text string")
    rows = lambda df: sorted((r.doc_id, r.pos, r.token, r.p) for r in df.collect())
    expected = rows(K.context_likelihood(new, K.fit(corpus, discount)))
    got = rows(K.likelihood_in(new, corpus, discount))
    assert [r[:3] for r in got] == [r[:3] for r in expected] and [r[3] for r in got] == pytest.approx([r[3] for r in expected], rel=1e-12)
    assert rows(K.likelihood_in(new, corpus.limit(0))) == [] == rows(K.likelihood_in(new.limit(0), corpus))
    monkeypatch.setattr(K, "MOST_ASKED", 5)
    assert [r[3] for r in rows(K.likelihood_in(new, corpus, discount))] == pytest.approx([r[3] for r in expected], rel=1e-12)


def test_answers_store_no_model(spark):
    """Questions of the benchmark leave less on disk than a tenth of the texts; the model's tables take several times as much."""
    before = written(spark)
    assert catalogue.queries()["context_likelihood"](spark, SF).count()
    assert written(spark) - before < Path(f"{SF}/documents.parquet").stat().st_size / 10


def test_lowest_order_alone(spark):
    """The same words as the whole model's, and less left on disk than the texts take."""
    corpus = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    rows = lambda df: {(r.way, r.w): r.p for r in df.collect()}
    assert rows(K.word_continuations(corpus)) == pytest.approx(rows(K.fit(corpus).words), rel=1e-12)
    assert rows(K.word_continuations(corpus.limit(0))) == {}
    before = written(spark)
    assert catalogue.queries()["context_words"](spark, SF).count()
    assert written(spark) - before < Path(f"{SF}/documents.parquet").stat().st_size


def test_pair_likelihood_without_a_table_of_pairs(spark, monkeypatch):
    corpus = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    new = spark.createDataFrame([(1, "the good rare film"), (2, ""), (3, None), (4, "Film the"), (5, "new newer the good end of the film")], "doc_id long, text string")
    rows = lambda df: sorted((r.doc_id, r.pos, r.token, r.p) for r in df.collect())
    expected = rows(mining.word_likelihood(new, mining.fit_word_model(corpus)))
    got = rows(mining.word_likelihood_in(new, corpus))
    assert [r[:3] for r in got] == [r[:3] for r in expected] and [r[3] for r in got] == pytest.approx([r[3] for r in expected], rel=1e-12)
    assert rows(mining.word_likelihood_in(new.limit(0), corpus)) == []
    monkeypatch.setattr(mining, "MOST_ASKED", 3)
    assert [r[3] for r in rows(mining.word_likelihood_in(new, corpus))] == pytest.approx([r[3] for r in expected], rel=1e-12)
    monkeypatch.undo()
    before, kept = written(spark), spark.sparkContext._jsc.getPersistentRDDs().size()
    assert catalogue.queries()["likelihood_sweep"](spark, SF).count() == 10
    assert written(spark) == before and spark.sparkContext._jsc.getPersistentRDDs().size() == kept
