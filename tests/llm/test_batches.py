"""Arrow batches of any size give the same near-duplicate classes."""

from __future__ import annotations

import pyarrow as pa
import pytest

from trustlake.llm import _words, minhash_dedup


def test_parts_keep_order_and_bounds():
    batch = pa.RecordBatch.from_arrays([pa.array([f"t{k}" for k in range(50_001)])], names=["text"])
    cut = list(_words.parts(batch, "text"))
    assert max(p.num_rows for p in cut) <= 1 << 14
    assert [t for p in cut for t in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert sum(len(p) for p in _words.parts(batch.slice(0, 0), "text")) == 0


@pytest.mark.parametrize("rows", [1000, 60_000])
def test_classes_do_not_depend_on_the_batch(spark, rows):
    """20,000 texts in pairs of near copies, in one partition."""
    texts = [" ".join(f"w{k // 2}x{j}" for j in range(30)) + (" end" if k % 2 else "") for k in range(20_000)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = {r.doc_id: r.class_id for r in minhash_dedup.minhash_dedup(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: k - k % 2 for k in range(20_000)}
