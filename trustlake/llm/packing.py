"""Packing documents into sequences: a configuration linear program over the length histogram.

Texts are tokenised once, where they are. Documents longer than a sequence are
cut from the end, so that only the first piece can be shorter; full pieces are
sequences of their own. What is left to pack is known by its histogram, at most
one count for each length, and only that reaches the driver.

The linear program has a variable for each configuration (multiset of lengths
that fits a sequence) and a covering row for each length. It is solved by
multiplicative weights: a length weighs less the more it is covered, and one
knapsack dynamic program a round prices all configurations. Weights over the
best knapsack value bound any packing from below. Shares are rounded to whole
sequences, the program is solved again for what that leaves, and the rest goes
best-fit decreasing, counts of equal lengths at once, into the room that is
left. Best-fit decreasing of everything is tried as well, and the fewer
sequences are taken.

The plan is a table of slots: so many sequences of a configuration, each with
places for lengths. Pieces are numbered within their length in two steps
(counts by hash bucket, then rows in the bucket), so no task gets all pieces of
one length, and the n-th piece of a length takes its n-th place.

Token ids are those of the given tokenizer. A chunk (white space, then the word
behind it) gives the same ids in any text, so each different chunk of a batch is
tokenised once and ids are gathered; Unicode white space joins chunks.

Edge cases: a null or empty text is a document of the end id alone; a null
doc_id is a document like any other; rows that repeat a doc_id are packed one
by one; very long texts are cut into pieces; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlake.llm import _words
from trustlake.llm._session import stored

LENGTH = 2048
END = 0
#: Lengths below a SMALL-th of a sequence aren't in the program; best fit puts them into what room is left.
SMALL = 32
#: Rounds of multiplicative weights, most coverage a round adds, and how near to the best configuration others must be.
ROUNDS, STEP, NEAR = 60, 0.05, 0.01
#: The program is solved again for what rounding leaves, so many times at most; part of a share that is rounded.
PHASES, SURE = 6, 0.7
#: Hash buckets in which the pieces of one length are numbered.
BUCKETS = 1024
#: Bytes of text that are tokenised at once.
TEXT = 16 << 20
#: Chunks whose ids a Python process remembers.
KNOWN = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Last bytes of white space beyond ASCII, behind which a chunk doesn't end (UTF-8, fixed).
WIDE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", *(bytes([0xE2, 0x80, b]) for b in range(0x80, 0x8B)), b"\xe2\x80\xa8", b"\xe2\x80\xa9", b"\xe2\x80\xaf", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: ASCII punctuation but the apostrophe, which may start a contraction.
_MARK = _words._PUNCT.copy()
_MARK[[*range(0x21), 0x27, 0x7F]] = False
#: Chunks that are one pretoken: ASCII and Latin-1 letters, behind a space or not.
_PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Byte-level vocabularies show each byte as a letter: a printable Latin-1 one as itself, the others from 256 on, in order.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_VISIBLE = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_SPACE = chr(_VISIBLE[0x20])


def _chunks(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All chunks of a batch of texts, and the n + 1 offsets of the texts' chunks. No pretoken of a byte-level tokenizer crosses a cut, nor does one look beyond it."""
    data, offsets = _words.text_bytes(column)
    _, end = _words._spans(data, offsets, _words._SPACE)
    # A word that ends in wide white space, or in a control that some take for it, goes on.
    last = data[end - 1]
    odd = np.flatnonzero((last >= 0x80) | ((last >= 0x1C) & (last <= 0x1F)))
    stops = end < len(data)
    stops[odd[last[odd] < 0x80]] = False
    for tail in WIDE:
        same = odd[end[odd] >= len(tail)]
        for k, byte in enumerate(reversed(tail)):
            same = same[data[end[same] - 1 - k] == byte]
        stops[same] = False
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:-1] = _LETTER[data[:-1]] & _MARK[data[1:]]
    cut[end[stops]] = cut[offsets] = True
    cuts = np.flatnonzero(cut)
    if len(cuts) < 2:
        return pa.array([], pa.large_binary()), np.zeros(len(offsets), dtype=np.int64)
    chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return chunks, np.searchsorted(cuts, offsets)


class Ids:
    """Token ids of batches of texts by a tokenizer's file.

    With a byte-level tokenizer without normaliser each different chunk is
    tokenised once (``KNOWN`` short ones are remembered), a chunk that is one
    pretoken by the tokenizer's model alone. Texts that hold an added token,
    and all texts of other tokenizers, are tokenised whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        self.byte_level = made["normalizer"] is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.added = [t["content"] for t in made["added_tokens"]]
        self.model = self.tokenizer.model
        self.known: dict[bytes, list[int]] = {}

    def _of(self, chunks: list[bytes]) -> list[list[int]]:
        out = [self.known.get(c) for c in chunks]
        rest = []
        for k, ids in enumerate(out):
            if ids is None:
                if _PLAIN.fullmatch(chunks[k]):
                    shown = chunks[k].decode("latin-1")
                    shown = shown.replace(" ", _SPACE) if shown.isascii() else shown.translate(_VISIBLE)
                    out[k] = [t.id for t in self.model.tokenize(shown)]
                    self._keep(chunks[k], out[k])
                else:
                    rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([chunks[k].decode() for k in rest], add_special_tokens=False)):
            out[k] = e.ids
            self._keep(chunks[k], e.ids)
        return out

    def _keep(self, chunk: bytes, ids: list[int]) -> None:
        if len(self.known) < KNOWN and len(chunk) <= 32:
            self.known[chunk] = ids

    def _chunked(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chunks, first = _chunks(column)
        found = chunks.dictionary_encode()
        codes = found.indices.to_numpy().astype(np.int64)
        kinds = found.dictionary
        at, body = np.frombuffer(kinds.buffers()[1], dtype=np.int64)[: len(kinds) + 1].tolist(), kinds.buffers()[2].to_pybytes() if kinds.buffers()[2] else b""
        each = self._of([body[a:b] for a, b in zip(at[:-1], at[1:])])
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        flat = np.fromiter(itertools.chain.from_iterable(each), dtype="<u4", count=int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        return flat[np.repeat(begin[codes] - ends[:-1], n) + np.arange(ends[-1])], ends[first]

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """Ids (uint32) of each text, null counting as empty."""
        column = column.fill_null("")
        whole = np.full(len(column), not self.byte_level)
        for token in self.added:
            whole |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        flat, ends = self._chunked(column.filter(pa.array(~whole)))
        fast = iter([flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())])
        slow = iter(self.tokenizer.encode_batch(column.filter(pa.array(whole)).to_pylist(), add_special_tokens=False))
        return [np.array(next(slow).ids, dtype="<u4") if w else next(fast) for w in whole.tolist()]


@functools.lru_cache(1)
def _ids(path: str) -> Ids:
    """One for each Python process, from task to task."""
    return Ids(path)


def _pieces(path: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(path)
        for whole in batches:
            for batch in _words.parts(whole, "text", TEXT):
                row, piece, start, size, crc = [], [], [], [], []
                for k, own in enumerate(ids(batch.column(1))):
                    own = np.append(own, np.uint32(end)).astype("<u4")
                    n = len(own)
                    at = 0
                    for p in range(-(-n // length)):
                        to = n - (-(-n // length) - 1 - p) * length
                        row.append(k)
                        piece.append(p)
                        start.append(at)
                        size.append(to - at)
                        crc.append(zlib.crc32(own[at:to]))
                        at = to
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, size, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, *, length: int = LENGTH, end: int = END) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, piece, start, length, ids_crc32."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(path, length, end), PIECES)


@dataclass
class Slots:
    """``times`` sequences in which each length of ``parts`` has so many places."""

    parts: dict[int, int]
    times: int


def _knapsack(weights: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each room: the most weight that fits (repeats allowed), the row that it ends with, and the least room of the same weight."""
    best = np.zeros(length + 1)
    pick = np.full(length + 1, -1, dtype=np.int64)
    least = np.zeros(length + 1, dtype=np.int64)
    until = np.searchsorted(sizes, np.arange(length + 1), side="right")
    for c in range(1, length + 1):
        best[c], least[c] = best[c - 1], least[c - 1]
        if until[c]:
            v = weights[: until[c]] + best[c - sizes[: until[c]]]
            k = int(v.argmax())
            if v[k] > best[c]:
                best[c], pick[c], least[c] = v[k], k, c
    return best, pick, least


def _through(rows: np.ndarray, pick: np.ndarray, least: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """The best configuration that holds each of ``rows``: sorted rows, -1 where there are fewer."""
    columns = [rows]
    room = least[length - sizes[rows]]
    while (room > 0).any():
        row = np.where(room > 0, pick[room], -1)
        columns.append(row)
        room = np.where(row >= 0, least[np.where(row >= 0, room - sizes[row], 0)], 0)
    return np.sort(np.array(columns).T, axis=1)


def shares(sizes: np.ndarray, counts: np.ndarray, length: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Configurations (rows of ``sizes``, padded with -1), how often each is used, scaled to cover the pieces on average once, and a lower bound of any packing.

    A length's weight starts at its size and falls exponentially as it is
    covered. A round prices all configurations by one knapsack, takes the best
    one through each length (those within ``NEAR`` of the best of all) as often
    as the length occurs, and steps until some length is covered ``STEP`` more.
    """
    covered = np.zeros(len(sizes))
    mass = sizes * counts / float(sizes @ counts)
    bound = 0.0
    kinds, amounts = [], []
    for _ in range(rounds):
        weights = sizes * np.exp(-(covered - covered @ mass))
        best, pick, least = _knapsack(weights, sizes, length)
        # Duality: no configuration weighs more than best[length], all pieces together weights @ counts.
        bound = max(bound, float(weights @ counts) / best[length])
        rows = np.flatnonzero(weights + best[length - sizes] >= (1 - NEAR) * best[length])
        kind = _through(rows, pick, least, sizes, length)
        amount = counts[rows].astype(np.float64)
        gain = np.bincount(kind[kind >= 0], np.broadcast_to(amount[:, None], kind.shape)[kind >= 0], minlength=len(sizes)) / counts
        step = STEP / gain.max()
        covered += step * gain
        kinds.append(kind)
        amounts.append(step * amount)
    width = max(k.shape[1] for k in kinds)
    kinds = np.concatenate([np.pad(k, ((0, 0), (width - k.shape[1], 0)), constant_values=-1) for k in kinds])
    kinds, of = np.unique(kinds, axis=0, return_inverse=True)
    return kinds, np.bincount(of.ravel(), np.concatenate(amounts)) / float(covered @ mass), bound


def best_fit(counts: dict[int, int], length: int, opened: list[Slots] | None = None) -> list[Slots]:
    """Best-fit decreasing into ``opened`` sequences and new ones; equal lengths and equally filled sequences are handled at once."""
    rooms: dict[int, dict[tuple, int]] = {}
    there = np.zeros(length + 1, dtype=bool)

    def put(room: int, parts: tuple, times: int) -> None:
        own = rooms.setdefault(room, {})
        own[parts] = own.get(parts, 0) + times
        there[room] = True

    for slot in opened or []:
        parts = tuple(slot.parts.items())
        put(length - sum(s * n for s, n in parts), parts, slot.times)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = size + int(there[size:].argmax())
            if not there[room]:
                fit = length // size
                for many, times in ((fit, left // fit), (left % fit, 1)):
                    if many and times:
                        put(length - many * size, ((size, many),), times)
                break
            parts, times = next(iter(rooms[room].items()))
            fit = room // size
            take = min(times, left // fit) or 1
            many = min(fit, left)
            rooms[room][parts] -= take
            if not rooms[room][parts]:
                del rooms[room][parts]
                there[room] = bool(rooms[room])
            own = dict(parts)
            own[size] = own.get(size, 0) + many
            put(room - many * size, tuple(own.items()), take)
            left -= many * take
    return [Slots(dict(parts), times) for kinds in rooms.values() for parts, times in kinds.items()]


def _rounded(kinds: np.ndarray, share: np.ndarray, sizes: np.ndarray, left: np.ndarray) -> list[Slots]:
    """Shares in falling order, rounded to whole sequences (one at least), as long as ``left`` has the pieces, which are taken off it."""
    out = []
    for k in np.argsort(-share, kind="stable").tolist():
        rows, many = np.unique(kinds[k][kinds[k] >= 0], return_counts=True)
        times = min(int((left[rows] // many).min()), max(1, int(share[k] * SURE)))
        if times > 0:
            left[rows] -= times * many
            out.append(Slots(dict(zip(sizes[rows].tolist(), many.tolist())), times))
    return out


def plan(counts: dict[int, int], length: int = LENGTH) -> tuple[list[Slots], int]:
    """Slots with a place for every piece, and a lower bound of the number of sequences."""
    full = counts.get(length, 0)
    rest = {s: n for s, n in counts.items() if s < length and n}
    whole = [Slots({length: 1}, full)] if full else []
    if not rest:
        return whole, full
    bound = -(-sum(s * n for s, n in rest.items()) // length)
    sizes = np.array(sorted(s for s in rest if s * SMALL >= length), dtype=np.int64)
    left = np.array([rest[s] for s in sizes.tolist()], dtype=np.int64)
    best, slots = best_fit(rest, length), []
    for _ in range(PHASES):
        live = np.flatnonzero(left)
        if not len(live):
            break
        before = int(sizes @ left)
        kinds, share, dual = shares(sizes[live], left[live], length)
        bound = bound if slots else max(bound, int(np.ceil(dual - 1e-6)))
        own = left[live]
        slots += _rounded(kinds, share, sizes[live], own)
        left[live] = own
        packed = best_fit({**{s: n for s, n in rest.items() if s * SMALL < length}, **{s: n for s, n in zip(sizes.tolist(), left.tolist()) if n}}, length, slots)
        best = min(best, packed, key=lambda way: sum(s.times for s in way))
        if sum(s.times for s in best) <= bound or int(sizes @ left) > 0.7 * before:
            break
    return whole + best, full + bound


def _places(slots: list[Slots]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, in order: number of the first piece of a slot, first sequence, places a sequence, offset of the first place."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    sequence = 0
    for slot in slots:
        offset = 0
        for size, many in slot.parts.items():
            rows.setdefault(size, []).append((taken[size], sequence, many, offset))
            taken[size] += many * slot.times
            offset += size * many
        sequence += slot.times
    return {size: tuple(np.array(c) for c in zip(*r)) for size, r in rows.items()}


def _assign(places: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, begin, many, start = places[int(s)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                inner = rank[at] - first[k]
                sequence[at] = begin[k] + inner // many[k]
                offset[at] = start[k] + inner % many[k] * s
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, *, length: int = LENGTH, end: int = END) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset. ``path``: the tokenizer's file, which every executor has."""
    own = stored(pieces(docs, path, length=length, end=end), "pieces")
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int")
    own = own.withColumn("bucket", bucket)
    counts = stored(own.groupBy("length", "bucket").agg(F.count("*").alias("n")), "counts")
    # At most one row for each length.
    lengths = {r["length"]: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(lengths, length)
    # At most BUCKETS rows for each length.
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = stored(counts.select("length", "bucket", before.alias("before")), "starts")
    rank = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = own.withColumn("rank", rank).join(starts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    columns = [f.name for f in own.schema if f.name != "bucket"]
    return ranked.select(*columns, "rank").mapInArrow(_assign(_places(slots)), PIECES + ", sequence_id long, offset long")


def op13_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
