"""Exchange of many small keys in blocks.

A task that would send a hundred million (key, value) rows to the shuffle
sends, for each bucket of keys, one row with packed little-endian columns
instead. Spark still partitions and shuffles the rows by ``bucket``; each
receiving task sees its buckets one after the other. Senders combine equal
keys first, so a hot key costs one entry for each batch, not one for each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm._words import mix

#: Buckets for each shuffle partition. A task holds one bucket at a time; more of them mean less memory and, with fewer
#: entries of a document in each, more bytes for the documents' ids.
BUCKETS = 2


def schema(**columns: str) -> str:
    """DDL of packed rows with these columns (numpy types)."""
    return "bucket int, " + ", ".join(f"{c} binary" for c in columns)


def pack(bucket: np.ndarray, columns: dict[str, np.ndarray], more: dict[str, int] | None = None) -> pa.RecordBatch | None:
    """One row for each bucket; entries keep their order."""
    if not len(bucket):
        return None
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 65536 else bucket, kind="stable")
    b = bucket[order]
    first = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1])
    arrays = [pa.array(b[first].astype(np.int32))]
    for c in columns.values():
        c = np.ascontiguousarray(c[order])
        size = c.itemsize
        offsets = np.append(first, len(b)) * size
        arrays.append(pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(c)]))
    names = ["bucket", *columns]
    for k, v in (more or {}).items():
        arrays.append(pa.array(np.full(len(first), v, dtype=np.int32)))
        names.append(k)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def exchanged(df: DataFrame, partitions: int) -> DataFrame:
    """Rows of a bucket together, buckets of a task one after the other."""
    return df.repartitionById(partitions, F.col("bucket") % partitions).sortWithinPartitions("bucket")


def each_bucket(batches: Iterator[pa.RecordBatch], types: dict[str, str]) -> Iterator[dict[str, np.ndarray]]:
    """Entries of one bucket after the other; ``types`` are the numpy types of the packed columns."""
    now, held = None, {c: [] for c in types}

    def out() -> dict[str, np.ndarray]:
        whole = {c: np.frombuffer(b"".join(held[c]), dtype=t) for c, t in types.items()}
        for c in held:
            held[c] = []
        return whole

    for batch in batches:
        buckets = batch.column(batch.schema.get_field_index("bucket")).to_numpy(zero_copy_only=False)
        cols = {c: batch.column(batch.schema.get_field_index(c)) for c in types}
        for i, b in enumerate(buckets):
            if now is not None and b != now:
                yield out()
            now = b
            for c in types:
                held[c].append(cols[c][i].as_py())
    if now is not None:
        yield out()


def doc_bucket(doc: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets of documents, even for ids in steps."""
    return (mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)


def to_docs(doc: np.ndarray, tag: np.ndarray, value: np.ndarray, n_buckets: int) -> pa.RecordBatch | None:
    """Entries (doc, tag, value) on their way to their rows: packed by bucket of the document."""
    if not len(doc):
        return None
    order = np.lexsort((value, tag, doc))
    doc, tag, value = doc[order], tag[order], value[order]
    return pack(doc_bucket(doc, n_buckets), {"doc": doc.astype("<i8"), "tag": tag.astype("<i4"), "value": value.astype("<i4")})


DOC_TYPES = {"doc": "<i8", "tag": "<i4", "value": "<i4"}


def by_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, tag, packed values in order) of one bucket after the other."""
    for e in each_bucket(batches, DOC_TYPES):
        order = np.lexsort((e["value"], e["tag"], e["doc"]))
        d, t, v = e["doc"][order], e["tag"][order], np.ascontiguousarray(e["value"][order])
        first = np.concatenate([[0], np.flatnonzero((d[1:] != d[:-1]) | (t[1:] != t[:-1])) + 1])
        offsets = np.append(first, len(d)) * v.itemsize
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(v)])
        yield pa.RecordBatch.from_arrays([pa.array(d[first]), pa.array(t[first]), packed], names=["doc_id", "tag", "packed"])


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
