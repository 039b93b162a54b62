"""Quality classifier: a generalised additive model with pairwise interactions.

Every text is turned into ``FEATURES`` numbers by numpy passes over its bytes
and words. The model is a sum of lookup tables: one per feature, over the
feature's bins, and one per chosen pair of features, over a coarse grid. Tables
are learnt by cyclic boosting: round by round, each feature in turn gets a
shallow tree on the present residuals, at a low learning rate; then the pairs
with the largest gain on what is left get theirs. Scoring looks up and adds.

Fitting uses at most ``SAMPLE`` labelled rows (those with the smallest hashes
of doc_id), a documented bound; statistics and scores cover every text.

Edge cases: null and empty texts get the score of an empty text; labels that
are null are ignored, several labels of one document count as their mean; with
one class, or no label, the score is the smoothed share of ones; a null doc_id
is scored; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.llm._words import groups, parts, text_bytes, words

SAMPLE = 20_000
BINS, GRID, PAIRS = 48, 10, 8
ROUNDS, PAIR_ROUNDS, RATE, LAMBDA = 150, 60, 0.15, 1.0
CUT = 0.3

# Byte classes: letters, upper-case letters, digits, blanks, line ends, and groups of marks.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "line": b"\n", "stop": b".?", "bang": b"!", "comma": b",;:", "symbol": b"#$%&*@^~_=+<>/\\", "pipe": b"|", "quote": b"\"'()[]{}-"}
_CLASS = np.full(256, len(CLASSES), dtype=np.uint8)
for _k, _b in enumerate(CLASSES.values()):
    _CLASS[list(_b)] = _k
_CLASS[128:] = len(CLASSES) + 1
FEATURES = [*CLASSES, "rest", "beyond_ascii", "log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "top_word", "short_words", "words_per_stop"]


def held_out(doc_id: Column, modulus: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 0, F.lit(False))


def features(text: pa.Array) -> np.ndarray:
    """Rows of FEATURES for a column of texts."""
    data, offsets = text_bytes(text)
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, len(FEATURES)))
    some = np.flatnonzero(size)
    kinds = _CLASS[data]
    for k in range(len(CLASSES) + 2):
        if len(some):
            out[some, k] = np.add.reduceat(kinds == k, offsets[:-1][some], dtype=np.int64) / size[some]
    w = words(text, lower=True)
    count = w.count
    length = w.end - w.start
    k = len(CLASSES) + 2
    own = np.flatnonzero(count)
    out[:, k] = np.log1p(size)
    out[:, k + 1] = np.log1p(count)
    if len(own):
        first = w.first[:-1][own]
        out[own, k + 2] = np.add.reduceat(length, first) / count[own]
        out[own, k + 3] = np.log1p(np.maximum.reduceat(length, first))
        out[own, k + 6] = np.add.reduceat(length <= 2, first, dtype=np.int64) / count[own]
        doc = w.doc
        key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (w.hash >> np.uint64(20)))
        at = groups(key)
        times = np.diff(np.append(at, len(key)))
        of = (key[at] >> np.uint64(44)).astype(np.int64)
        start = groups(of)
        out[own, k + 4] = np.diff(np.append(start, len(of))) / count[own]
        out[own, k + 5] = np.maximum.reduceat(times, start) / count[own]
    out[:, k + 7] = np.log1p(count / np.maximum(out[:, 4] * size, 1))
    return out


class Additive:
    """Bin edges and lookup tables."""

    def __init__(self, prior: float) -> None:
        self.prior = prior
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.coarse: list[np.ndarray] = []
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            z += grid[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + LAMBDA)


def _stump(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to three leaves over a feature's bins: the step to add to each bin."""
    bounds = [0, len(g)]
    for _ in range(2):
        best, where = 1e-6, None
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            if z - a < 2:
                continue
            cg, ch = np.cumsum(g[a:z]), np.cumsum(h[a:z])
            gains = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
            k = int(gains.argmax())
            if gains[k] > best:
                best, where = gains[k], a + k + 1
        if where is None:
            break
        bounds = sorted([*bounds, where])
    step = np.empty(len(g))
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        step[a:z] = g[a:z].sum() / (h[a:z].sum() + LAMBDA)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of four leaves over a grid (one cut for each feature), and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, b = (cg[:-1, :-1], ch[:-1, :-1]), (cg[:-1, -1:] - cg[:-1, :-1], ch[:-1, -1:] - ch[:-1, :-1])
    c = (cg[-1:, :-1] - cg[:-1, :-1], ch[-1:, :-1] - ch[:-1, :-1])
    d = (tg - a[0] - b[0] - c[0], th - a[1] - b[1] - c[1])
    gains = sum(_gain(*x) for x in (a, b, c, d))
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    step = np.empty(g.shape)
    for rows, cols, x in ((slice(None, i + 1), slice(None, j + 1), a), (slice(None, i + 1), slice(j + 1, None), b), (slice(i + 1, None), slice(None, j + 1), c), (slice(i + 1, None), slice(j + 1, None), d)):
        step[rows, cols] = x[0][i, j] / (x[1][i, j] + LAMBDA)
    return step, float(gains[i, j])


def boost(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting on a bounded sample."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    m = Additive(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return m
    m.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    m.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, GRID + 1)[1:-1])) for c in x.T]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(m.edges, x.T, strict=True)]
    cells = [np.searchsorted(e, c, side="right") for e, c in zip(m.coarse, x.T, strict=True)]
    z = np.full(len(y), m.prior)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _stump(np.bincount(b, g, len(m.tables[j])), np.bincount(b, h, len(m.tables[j])))
            m.tables[j] += step
            z += step[b]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = (len(m.coarse[i]) + 1, len(m.coarse[j]) + 1)
        return np.bincount(cells[i] * shape[1] + cells[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = []
    for i in range(x.shape[1]):
        for j in range(i):
            if len(m.coarse[i]) and len(m.coarse[j]):
                ranked.append((_quadrants(grid(i, j, g), grid(i, j, h))[1], i, j))
    m.pairs = [(i, j) for _, i, j in sorted(ranked, reverse=True)[:PAIRS]]
    m.grids = [np.zeros((len(m.coarse[i]) + 1, len(m.coarse[j]) + 1)) for i, j in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(m.pairs):
            g, h = slopes()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[0]
            m.grids[k] += step
            z += step[cells[i], cells[j]]
    return m


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in parts(whole, "text"):
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], names=["label", "x"])


def _score(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text"):
                s = model.value.score(features(batch.column(2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE) -> Additive:
    """Learn from at most ``sample`` rows of ``labels`` (doc_id, label column) and the texts of ``docs`` (doc_id, text)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most ``sample`` rows of two numbers.
    rows = text.join(F.broadcast(known), "doc_id").select("label", "text").mapInArrow(_featurise, "label double, x array<double>").toPandas()
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    y = rows["label"].to_numpy(float)
    # The order in which tasks deliver rows must not matter.
    order = np.lexsort(np.column_stack([x, y]).T) if len(y) else np.zeros(0, dtype=int)
    return boost(x[order], y[order])


def score(docs: DataFrame, model: Additive, held: Column) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, score double, predicted int")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = held_out(F.col("doc_id"))
    return score(docs, fit(docs, labels.filter(~held)), held)
