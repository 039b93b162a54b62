"""Substring dedup with difference-cover anchors.

A word window of ``LENGTH`` words is removed from a document when the same
word sequence also starts in a document with a smaller id. Hashing each
window of each text and shuffling all of them would cost more than the texts.
Instead, only 7-word anchors at positions whose remainder modulo 7 lies in the
difference cover {1, 2, 4} are hashed: for any two places of a shared window
there is a shift of at most 6 at which both places are cover positions, and
the anchor there lies inside the window (6 + 7 = 13). So windows without an
anchor that a second document has can't repeat. The others are extended to
their full length and compared by hashes of 96 bits and those of the bucket;
the words themselves aren't compared once more.

Whole copies of a text are settled first, by a digest of the text; only the
copy with the smallest id goes on. Digests of very many texts are broadcast
(there can be few of them), so that no task gets all rows of one.

Shuffles: texts once (the joins by doc_id reuse the exchange), anchors once,
full windows near shared anchors once. Equal anchors and windows of an Arrow batch
are combined before the shuffle, so a passage in a third of all documents
sends one entry for each batch.

Edge cases: a null text counts as empty; texts under 13 words keep all words;
equal windows inside one document don't count; rows that repeat a doc_id with
the same or another text don't count against each other, and each loses what a
smaller doc_id has (rows are told apart by doc_id and a tag of the text); rows
without a doc_id keep all words; very long texts are taken whole, as the only
text of a step; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm import _blocks as B
from trustlake.llm._session import keyed_join, partitions, stored
from trustlake.llm._words import groups, inside, mix, parts, windows, words

#: Perfect difference cover modulo 7: each remainder is a difference of two members.
PERIOD, COVER, LENGTH = 7, (1, 2, 4), 13
ANCHOR = LENGTH - PERIOD + 1
SECOND = 0x5851F42D4C957F2D

#: Anchors are a filter: 48 bits and those of the bucket. Windows decide: 96 bits and those of the bucket.
ANCHOR_TYPES = {"low": "<u4", "high": "<u2", "doc": "<i8", "tag": "<i4", "pos": "<i4", "known": "u1"}
WINDOW_TYPES = {"low": "<u4", "high": "<u4", "hash2": "<u4", "doc": "<i8", "tag": "<i4", "pos": "<i4", "known": "u1"}
SUMMARY = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _anchors(n_buckets: int) -> B.Mapper:
    """Each batch's anchors: one entry for each hash of one document, one entry of many documents' hashes and marks for these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole.filter(whole.column(0).is_valid()), "text"):
                ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
                w = words(batch.column("text"))
                at = inside(w, ANCHOR)
                doc, pos = w.doc, w.position
                at = at[np.isin(pos[at] % PERIOD, COVER) & (w.count[doc[at]] >= LENGTH)]
                yield from _entries(windows(w, ANCHOR)[at], None, ids[doc[at]], tags[doc[at]], pos[at], n_buckets)

    return run


def _entries(h: np.ndarray, h2: np.ndarray | None, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Combine equal hashes of a batch. What a smaller or (for anchors) any other document of the batch settles is marked ``known``."""
    if not len(h):
        return
    order = np.lexsort((doc, h))
    h, doc, tag, pos = h[order], doc[order], tag[order], pos[order]
    new = h[1:] != h[:-1]
    if h2 is not None:
        h2 = h2[order]
        again = np.lexsort((doc, h2, h))
        h, h2, doc, tag, pos = h[again], h2[again], doc[again], tag[again], pos[again]
        new = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    size = np.diff(np.append(first, len(h)))
    low, high = np.repeat(doc[first], size), np.repeat(doc[first + size - 1], size)
    shared = low != high
    head = np.zeros(len(h), dtype=bool)
    head[first] = True
    if h2 is None:
        # Shared inside the batch: all its places are marked; one entry tells the other batches.
        marks, ask = shared, ~shared | head
        known = shared
    else:
        # A smaller document of the batch has it: covered. The smallest one asks.
        marks, ask = doc != low, doc == low
        known = np.zeros(len(h), dtype=bool)
    tell = np.flatnonzero(ask)
    tell = tell[np.lexsort((pos[tell], tag[tell], doc[tell]))]
    types = ANCHOR_TYPES if h2 is None else WINDOW_TYPES
    cols = {"low": h[tell] & np.uint64(0xFFFFFFFF), "high": (h[tell] >> np.uint64(32)) & np.uint64(0xFFFF if h2 is None else 0xFFFFFFFF), "doc": doc[tell], "tag": tag[tell], "pos": pos[tell], "known": known[tell]}
    if h2 is not None:
        cols["hash2"] = h2[tell] & np.uint64(0xFFFFFFFF)
    out = B.pack((mix(h[tell]) % np.uint64(n_buckets)).astype(np.int64), {c: cols[c].astype(t) for c, t in types.items()})
    if out is not None:
        yield out
    done = np.flatnonzero(marks)
    if len(done):
        done = done[np.lexsort((pos[done], tag[done], doc[done]))]
        cols = {"doc": doc[done], "tag": tag[done], "pos": pos[done], "known": np.full(len(done), 2)}
        yield B.pack(B.doc_bucket(doc[done], n_buckets), {c: cols.get(c, np.zeros(len(done))).astype(t) for c, t in types.items()})


def _joined(e: dict[str, np.ndarray]) -> np.ndarray:
    return e["low"].astype(np.uint64) | (e["high"].astype(np.uint64) << np.uint64(32))


def _shared_anchors(n_buckets: int) -> B.Mapper:
    """Places whose anchor a second document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in B.each_bucket(batches, ANCHOR_TYPES):
            done = e["known"] == 2
            marks = [[e[c][done] for c in ("doc", "tag", "pos")]]
            h = _joined(e)[~done]
            doc, tag, pos, known = (e[c][~done] for c in ("doc", "tag", "pos", "known"))
            if len(h):
                order = np.argsort(h)
                h, doc, tag, pos, known = h[order], doc[order], tag[order], pos[order], known[order]
                first = groups(h)
                size = np.diff(np.append(first, len(h)))
                hit = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)) | (np.maximum.reduceat(known, first) > 0)
                # The entry that stands for a batch's shared places is marked there already.
                hit = np.repeat(hit, size) & (known == 0)
                marks.append([doc[hit], tag[hit], pos[hit]])
            out = B.to_docs(*(np.concatenate(x) for x in zip(*marks, strict=True)), n_buckets)
            if out is not None:
                yield out

    return run


def _extend(n_buckets: int) -> B.Mapper:
    """Full windows around shared anchors, as (hash, place) entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole.filter(whole.column("packed").is_valid()), "text"):
                ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
                w = words(batch.column("text"))
                mark = np.zeros(len(w.hash) + 1, dtype=np.int32)
                for d, packed in enumerate(batch.column("packed")):
                    if packed.is_valid:
                        mark[w.first[d] + np.frombuffer(packed.as_buffer(), dtype="<i4")] = 1
                seen = np.concatenate([[0], np.cumsum(mark)])
                at = inside(w, LENGTH)
                at = at[seen[at + PERIOD] > seen[at]]
                if len(at):
                    second = words(batch.column("text"), seed=SECOND)
                    doc = np.searchsorted(w.first, at, side="right") - 1
                    yield from _entries(windows(w, LENGTH)[at], windows(second, LENGTH)[at], ids[doc], tags[doc], at - w.first[doc], n_buckets)

    return run


def _covered(n_buckets: int) -> B.Mapper:
    """Window starts whose word sequence a smaller document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in B.each_bucket(batches, WINDOW_TYPES):
            done = e["known"] == 2
            found = [[e[c][done] for c in ("doc", "tag", "pos")]]
            h = _joined(e)[~done]
            h2, d, t, p = (e[c][~done] for c in ("hash2", "doc", "tag", "pos"))
            if len(h):
                order = np.lexsort((d, h2, h))
                h, h2, d, t, p = h[order], h2[order], d[order], t[order], p[order]
                first = np.concatenate([[0], np.flatnonzero((h[1:] != h[:-1]) | (h2[1:] != h2[:-1])) + 1])
                later = d != np.repeat(d[first], np.diff(np.append(first, len(h))))
                found.append([d[later], t[later], p[later]])
            out = B.to_docs(*(np.concatenate(x) for x in zip(*found, strict=True)), n_buckets)
            if out is not None:
                yield out

    return run


def _cut(text_out: bool) -> B.Mapper:
    """Remove the words that covered windows span, and all words of whole copies from ``LENGTH`` words on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text"):
                text_of = batch.column("text")
                w = words(text_of)
                step = np.zeros(len(w.hash) + LENGTH + 1, dtype=np.int64)
                for d, packed in enumerate(batch.column("packed")):
                    if packed.is_valid:
                        start = w.first[d] + np.unique(np.frombuffer(packed.as_buffer(), dtype="<i4"))
                        step[start] += 1
                        step[start + LENGTH] -= 1
                gone = np.cumsum(step)[: len(w.hash)] > 0
                copy = batch.column("copy").to_numpy(zero_copy_only=False).astype(bool) & (w.count >= LENGTH)
                gone |= np.repeat(copy, w.count)
                removed = np.concatenate([[0], np.cumsum(gone)])
                removed = removed[w.first[1:]] - removed[w.first[:-1]]
                kept = []
                for d, text in enumerate(text_of):
                    if removed[d]:
                        a = w.first[d]
                        own = [w.data[w.start[i] : w.end[i]].tobytes() for i in np.flatnonzero(~gone[a : w.first[d + 1]]) + a]
                    else:
                        own = (text.as_py() or "").encode().split()
                    kept.append(b" ".join(own))
                cols = {"doc_id": batch.column("doc_id"), "n_words": pa.array(w.count.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept])}
                if text_out:
                    # An unchanged text stays as it is.
                    cols["kept_text"] = pa.array([k.decode() if gone_here else text.as_py() for k, gone_here, text in zip(kept, removed, text_of, strict=True)], pa.string())
                cols |= {batch.schema.names[i]: batch.column(i) for i in range(5, batch.num_columns)}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def substring_dedup(docs: DataFrame, *, text_out: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id long, text string, ...) -> doc_id, n_words, n_removed, kept_sha256, with ``text_out`` kept_text, and the columns ``keep``."""
    spark = docs.sparkSession
    n = partitions(spark)
    buckets = n * B.BUCKETS
    text = F.col("text").cast("string")
    digest = F.md5(text.cast("binary"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.conv(F.substring(digest, 1, 7), 16, 10).cast("int").alias("tag"), text.alias("text"), *keep)

    def by_doc(df: DataFrame, run: B.Mapper) -> DataFrame:
        return B.exchanged(df.mapInArrow(run, B.schema(**B.DOC_TYPES)), n).mapInArrow(B.by_doc, "doc_id long, tag int, packed binary")

    # A whole copy of a smaller document: all its windows are covered, and the smaller document stands for them.
    same = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("same"), F.length(text).alias("size")).filter("same IS NOT NULL AND doc_id IS NOT NULL"), "digests")
    several = stored(same.groupBy("same", "size").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1"), "copies")
    copies = keyed_join(same, several, ["same", "size"]).filter("doc_id > least").select("doc_id", F.conv(F.substring("same", 1, 7), 16, 10).cast("int").alias("tag"), F.lit(True).alias("copy")).distinct()
    # All three joins are left joins of the same rows and columns, so that they read one exchange of the texts.
    row = ["doc_id", "tag"]
    every = texts.join(copies, row, "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    own = every.filter(~F.col("copy")).select(*row, "text", *keep)
    anchors = B.exchanged(own.mapInArrow(_anchors(buckets), B.schema(**ANCHOR_TYPES)), n)
    marks = by_doc(anchors, _shared_anchors(buckets))
    near = own.join(marks, row, "left").select(*row, "text", "packed", *keep)
    full = B.exchanged(near.mapInArrow(_extend(buckets), B.schema(**WINDOW_TYPES)), n)
    covered = by_doc(full, _covered(buckets))
    whole = every.join(covered, row, "left").select(*row, "text", "packed", "copy", *keep)
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name in keep)
    return whole.mapInArrow(_cut(text_out), SUMMARY + (", kept_text string" if text_out else "") + more)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
win AS (SELECT doc_id, i, array_to_string(a[i:i + 12], ' ') AS s FROM (SELECT doc_id, a, unnest(range(1, len(a) - 11)) AS i FROM w WHERE len(a) >= 13)),
low AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
hit AS (SELECT doc_id, i FROM win JOIN low USING (s) WHERE doc_id > d),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
per AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN a ELSE list_transform(list_filter(list_zip(a, range(1, len(a) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN per USING (doc_id)
"""
