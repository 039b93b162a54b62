"""Counts of words, pairs and triples of a corpus, in little disk.

Every text is read as ``^ ^ words $ $``. Occurrences are counted only of words,
pairs and triples that are asked for, a bounded list that travels with the
function. What needs the whole corpus is distinct: which pairs there are, which
triples around an asked word, which words. Tasks drop what repeats in their
part of the texts and send the rest, packed and compressed, to hash buckets;
each bucket is made distinct and only numbers leave it. Words are compared
themselves, not by hashes. Read backward, a text gives the same triples
reversed with ``^`` and ``$`` exchanged, so one direction is enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "^", "$"
#: Words of a part that is made distinct at once: three of its codes fit 63 bits.
WINDOW = 1 << 21
#: Buckets for each shuffle partition; a task holds one at a time.
BUCKETS = 2
_PACKED = "bucket int, kind string, size long, data binary"
_NUMBERS = "kind string, id long, n long"
_CODEC = "zstd"


@dataclass
class Asked:
    """Words, pairs and triples to be counted; the words of all are among the words, a triple's pairs among the pairs."""

    words: list[str] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    triples: list[tuple[str, str, str]] = field(default_factory=list)


class _Lists:
    """The asked lists as sorted keys, with the places of the entries."""

    def __init__(self, asked: Asked) -> None:
        self.words = pa.array(asked.words, pa.string())
        n = max(len(asked.words), 1)
        at = {w: k for k, w in enumerate(asked.words)}
        self.n = n
        self.pair_keys, self.pair_at = self._sorted([at[x] * n + at[y] for x, y in asked.pairs])
        where = {k: i for i, k in enumerate(self.pair_keys.tolist())}
        # A triple is its first pair's place and its last word.
        self.triple_keys, self.triple_at = self._sorted([where[at[x] * n + at[y]] * n + at[z] for x, y, z in asked.triples])

    @staticmethod
    def _sorted(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(keys, dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        return keys[order], order

    def ids(self, vocabulary: pa.Array) -> np.ndarray:
        """Place of each word in the asked words, or -1."""
        return pc.fill_null(pc.index_in(vocabulary, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    @staticmethod
    def _places(keys: np.ndarray, listed: np.ndarray) -> np.ndarray:
        if not len(listed):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(listed, keys), len(listed) - 1)
        return np.where(listed[at] == keys, at, -1)

    def pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sorted place of each pair of word places, or -1."""
        return np.where((x >= 0) & (y >= 0), self._places(x * self.n + y, self.pair_keys), -1)

    def triples(self, pair: np.ndarray, z: np.ndarray) -> np.ndarray:
        return np.where((pair >= 0) & (z >= 0), self._places(pair * self.n + z, self.triple_keys), -1)


def marked(text: Column) -> Column:
    """``^ ^ words $ $`` with the words of ``portable.ascii_words``, one blank between."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z']+", " "))
    return F.when(words == "", f"{START} {START} {END} {END}").otherwise(F.concat(F.lit(f"{START} {START} "), words, F.lit(f" {END} {END}")))


def _hashes(vocabulary: pa.Array) -> np.ndarray:
    return pd.util.hash_array(vocabulary.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _packed(kind: str, bucket: np.ndarray, columns: list[np.ndarray], vocabulary: pa.Array) -> Iterator[tuple]:
    """A row for each bucket: the words in use and the entries as their numbers, both compressed. Entries come sorted by the first column."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 65536 else bucket, kind="stable")
    bucket = bucket[order]
    ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)) if len(bucket) else []
    first = 0
    for end in ends:
        part = [c[order[first:end]] for c in columns]
        used, codes = np.unique(np.concatenate(part), return_inverse=True)
        codes = codes.astype(np.uint32).reshape(len(columns), -1)
        # Differences of the sorted column are small; bytes of one weight stand together.
        codes[0, 1:] = np.diff(codes[0].astype(np.int64)).astype(np.uint32)
        width = 1 if len(used) <= 256 else 2 if len(used) <= 65536 else 4
        entries = codes.astype(f"<u{width}")
        words = " ".join(vocabulary.take(pa.array(used)).to_pylist()).encode()
        data = np.array([len(words), len(used), end - first], dtype="<i8").tobytes() + words + entries.view(np.uint8).reshape(len(columns), -1, width).transpose(0, 2, 1).tobytes()
        yield int(bucket[first]), kind, len(data), pa.compress(data, codec=_CODEC, asbytes=True)
        first = end


def _unpacked(size: int, data: bytes, columns: int) -> tuple[pa.Array, np.ndarray]:
    raw = pa.decompress(data, size, codec=_CODEC, asbytes=True)
    n_bytes, n_words, n = np.frombuffer(raw, dtype="<i8", count=3)
    width = 1 if n_words <= 256 else 2 if n_words <= 65536 else 4
    words = pa.array(raw[24 : 24 + n_bytes].decode().split(" "), pa.string())
    entries = np.frombuffer(raw, dtype=np.uint8, offset=24 + int(n_bytes)).reshape(columns, width, int(n)).transpose(0, 2, 1)
    codes = np.ascontiguousarray(entries).view(f"<u{width}").reshape(columns, int(n)).astype(np.int64)
    codes[0] = np.cumsum(codes[0])
    return words, codes


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], names=["bucket", "kind", "size", "data"])


def _numbers(kind: str, counts: np.ndarray, at: np.ndarray) -> list[tuple]:
    """Counts by sorted place as (place in the caller's list, n)."""
    some = np.flatnonzero(counts)
    return [(kind, i, n) for i, n in zip(at[some].tolist(), counts[some].tolist(), strict=True)]


_SMALL = ("n1", "n2", "n3")


def _sender(asked: Asked, kinds: frozenset[str], buckets: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, texts = _Lists(asked), 0
        totals = {"n1": np.zeros(len(asked.words), np.int64), "n2": np.zeros(len(asked.pairs), np.int64), "n3": np.zeros(len(asked.triples), np.int64)}
        for vocabulary, codes in _windows(batches):
            # Triples begin at every place but the window's last two; those that begin with an end mark reach into the next text.
            x, y, z = (codes[k : len(codes) - 2 + k] for k in range(3))
            start, end = (pc.index(vocabulary, w).as_py() for w in (START, END))
            inside = x != end
            pair = inside & (y != start)
            texts += int(np.count_nonzero(pair & (x == start)))
            ids = lists.ids(vocabulary)
            a, b, c = ids[x], ids[y], ids[z]
            if asked.words:
                totals["n1"] += np.bincount(a[pair & (a >= 0)], minlength=len(asked.words))
            if asked.pairs:
                at = lists.pairs(a, b)
                closing = lists.pairs(b, c)[inside & (y == end) & (z == end)]
                for found in (at[inside], closing):
                    totals["n2"] += np.bincount(found[found >= 0], minlength=len(asked.pairs))
                if asked.triples:
                    found = lists.triples(at, c)[inside]
                    totals["n3"] += np.bincount(found[found >= 0], minlength=len(asked.triples))
            out = []
            h = _hashes(vocabulary) if kinds & {"words", "pairs", "triples"} else None
            if "words" in kinds:
                some = np.unique(x[(x != start) & (x != end)])
                out += _packed("words", h[some] % np.uint64(buckets), [some], vocabulary)
            if "pairs" in kinds:
                keys = np.unique(x[pair] << 21 | y[pair])
                p, q = keys >> 21, keys & (WINDOW - 1)
                out += _packed("pairs", _mixed(h[p], h[q]) % np.uint64(buckets), [p, q], vocabulary)
            if "triples" in kinds:
                here = inside & (b >= 0)
                keys = np.unique(y[here] << 42 | x[here] << 21 | z[here])
                m, p, q = keys >> 42, keys >> 21 & (WINDOW - 1), keys & (WINDOW - 1)
                out += _packed("triples", _mixed(_mixed(h[p], h[m]), h[q]) % np.uint64(buckets), [m, p, q], vocabulary)
            if out:
                yield _rows(out)
        rows = []
        for kind, at in (("n1", np.arange(len(asked.words))), ("n2", lists.pair_at), ("n3", lists.triple_at)):
            some = np.flatnonzero(totals[kind])
            data = np.concatenate([at[some], totals[kind][some]]).astype("<i8").tobytes()
            if len(some):
                rows.append((int(at[some[0]]) % buckets, kind, len(data), pa.compress(data, codec=_CODEC, asbytes=True)))
        rows.append((0, "texts", texts, b""))
        yield _rows(rows)

    return send


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Vocabulary and codes of at most WINDOW words of some texts together; a window begins with the last two words of the one before."""
    for batch in batches:
        column = batch.column(0)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        # About 16 MB of texts at a time.
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(1, sizes.sum() // (16 << 20) + 1) * (16 << 20))
        for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(column)], strict=True):
            if first == end:
                continue
            words = pc.split_pattern(column.slice(first, end - first), " ").flatten().dictionary_encode()
            codes, vocabulary = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
            for k in range(0, len(codes) - 2, WINDOW - 2):
                part = codes[k : k + WINDOW]
                if len(vocabulary) > WINDOW:
                    used, part = np.unique(part, return_inverse=True)
                    yield vocabulary.take(pa.array(used)), part.astype(np.int64)
                else:
                    yield vocabulary, part


class _Bucket:
    """What one bucket got, one vocabulary for all."""

    def __init__(self, parts: dict[str, list[tuple[int, bytes]]]) -> None:
        self.parts = parts

    def distinct(self, kind: str, columns: int) -> tuple[pa.Array, list[np.ndarray]]:
        vocabularies, entries, n = [], [], 0
        for size, data in self.parts.get(kind, []):
            words, codes = _unpacked(size, data, columns)
            vocabularies.append(words)
            entries.append(codes + n)
            n += len(words)
        if not n:
            return pa.array([], pa.string()), [np.zeros(0, np.int64)] * columns
        encoded = pa.concat_arrays(vocabularies).dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[np.concatenate(entries, axis=1)]
        size = len(encoded.dictionary)
        if size**columns < 1 << 62:
            key = codes[0]
            for c in codes[1:]:
                key = key * size + c
            key, out = np.unique(key), []
            for _ in range(columns - 1):
                out.append(key % size)
                key = key // size
            return encoded.dictionary, [key, *out[::-1]]
        return encoded.dictionary, list(np.unique(codes, axis=1))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[_Bucket]:
    now, parts = None, {}
    for batch in batches:
        for bucket, kind, size, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now:
                if parts:
                    yield _Bucket(parts)
                now, parts = bucket, {}
            parts.setdefault(kind, []).append((size, data))
    if parts:
        yield _Bucket(parts)


def _exchanged(corpus: DataFrame, asked: Asked, kinds: frozenset[str], text_col: str) -> DataFrame:
    n = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = corpus.select(marked(F.col(text_col)).alias("t")).mapInArrow(_sender(asked, kinds, n * BUCKETS), _PACKED)
    return sent.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket")


def _receiver(asked: Asked) -> Callable:
    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, rows = _Lists(asked), []
        pairs = len(asked.pairs)
        for got in _by_bucket(batches):
            rows += [("texts", 0, sum(size for size, _ in got.parts.get("texts", [])))]
            for kind in _SMALL:
                for size, data in got.parts.get(kind, []):
                    at, n = np.frombuffer(pa.decompress(data, size, codec=_CODEC, asbytes=True), dtype="<i8").reshape(2, -1)
                    rows += [(kind, i, k) for i, k in zip(at.tolist(), n.tolist(), strict=True)]
            if "words" in got.parts:
                rows.append(("words", 0, len(got.distinct("words", 1)[1][0])))
            if "pairs" in got.parts:
                vocabulary, (x, y) = got.distinct("pairs", 2)
                rows.append(("pairs", 0, len(x)))
                ids = lists.ids(vocabulary)
                for kind, c in (("right", x), ("left", y)):
                    some = ids[c][ids[c] >= 0]
                    rows += _numbers(kind, np.bincount(some, minlength=len(asked.words)), np.arange(len(asked.words)))
            if "triples" in got.parts:
                vocabulary, (y, x, z) = got.distinct("triples", 3)
                ids = lists.ids(vocabulary)
                a, b, c = ids[x], ids[y], ids[z]
                rows += _numbers("around", np.bincount(b, minlength=len(asked.words)), np.arange(len(asked.words)))
                for kind, at in (("ends", lists.pairs(a, b)), ("starts", lists.pairs(b, c))):
                    rows += _numbers(kind, np.bincount(at[at >= 0], minlength=pairs), lists.pair_at)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["kind", "id", "n"])

    return receive


def counted(corpus: DataFrame, asked: Asked, *kinds: str, text_col: str = "text") -> dict[str, np.ndarray]:
    """Numbers about the asked lists, by place.

    Occurrences: ``n1`` (a word with something behind it), ``n2``, ``n3``, ``texts``.
    ``kinds`` has what else is wanted. words: ``words``, the number of distinct
    words. pairs: ``pairs``, the number of distinct pairs in ``^ words $``, and
    ``left``, ``right``: different words before and behind each asked word in
    them. triples: ``around``, different (word before, word behind) of an asked
    word; ``starts``, different words before an asked pair, ``ends``, behind it.
    """
    rows = _exchanged(corpus, asked, frozenset(kinds), text_col).mapInArrow(_receiver(asked), _NUMBERS).groupBy("kind", "id").agg(F.sum("n").alias("n")).toArrow()
    sizes = {"texts": 1, "words": 1, "pairs": 1, "n3": len(asked.triples)} | dict.fromkeys(("n1", "left", "right", "around"), len(asked.words)) | dict.fromkeys(("n2", "starts", "ends"), len(asked.pairs))
    out = {k: np.zeros(n, np.int64) for k, n in sizes.items()}
    kind, at, n = rows["kind"].to_numpy(), rows["id"].to_numpy(), rows["n"].to_numpy()
    for k, v in out.items():
        v[at[kind == k]] = n[kind == k]
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in _by_bucket(batches):
        vocabulary, (x, y) = got.distinct("pairs", 2)
        right, left = (np.bincount(c, minlength=len(vocabulary)) for c in (x, y))
        if len(vocabulary):
            yield pa.RecordBatch.from_arrays([vocabulary, pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["w", "left", "right"])


def neighbours(corpus: DataFrame, *, text_col: str = "text") -> DataFrame:
    """w, left, right: how many different words stand before and behind each word and mark in ``^ words $``."""
    each = _exchanged(corpus, Asked(), frozenset({"pairs"}), text_col).mapInArrow(_neighbours, "w string, left long, right long")
    return each.groupBy("w").agg(F.sum("left").alias("left"), F.sum("right").alias("right"))
