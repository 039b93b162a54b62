"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; letters keep their code point, everything else is one
blank. All 1-, 2- and 3-grams are hashed into ``DIMS`` columns. Training adds
up a count matrix (languages x DIMS) in each task; slices of the matrices are
summed after a shuffle. The matrix is bounded by the number of languages, so
its logarithms are broadcast. Prediction adds a text's log-probabilities.

The score is the winner's share of the posterior, tempered by the number of
n-grams (mean log-probability differences, times ``SHARP``), since a plain
posterior is 1.0 for nearly every text.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; with
no training text everything is ``und``; a null doc_id takes part in training;
ties go to the first language in code-point order; repeated rows and extra
columns are kept apart and ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.llm._session import partitions
from trustlake.llm._words import parts

DIMS = 1 << 16
ORDERS = 3
SLICES = 32
SHARP = 20.0
SMOOTH = 0.5
SEGMENT = 1 << 18

_LETTER = np.zeros(0x110000 + 1, dtype=bool)
_LETTER[[c for c in range(0x110000) if chr(c).isalpha()]] = True


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a blank before and after each, and the n+1 offsets."""
    texts = [(" " + t.lower() + " ") if t else "  " for t in column.to_pylist()]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def _features(points: np.ndarray) -> Iterator[np.ndarray]:
    """Columns of the n-grams that start at each point, order by order; -1 where the n-gram is all blank."""
    x = np.where(_LETTER[np.minimum(points, 0x110000)], points, np.uint32(32)).astype(np.uint64)
    h = np.zeros(len(x), dtype=np.uint64)
    for order in range(ORDERS):
        m = len(x) - order
        if m <= 0:
            return
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + x[order:] + np.uint64(order)
        f = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64)
        yield np.where(x[:m] == 32, -1, f) if order == 0 else f


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in parts(whole, "text"):
            points, offsets = _points(batch.column(1))
            langs, code = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
            lang_of = np.repeat(code, np.diff(offsets))
            for lo in range(0, len(points), SEGMENT):
                hi = min(lo + SEGMENT + ORDERS - 1, len(points))
                for f in _features(points[lo:hi]):
                    f = f[:SEGMENT]
                    own = lang_of[lo : lo + len(f)]
                    n = np.bincount(own[f >= 0] * DIMS + f[f >= 0], minlength=len(langs) * DIMS)
                    for k, name in enumerate(langs):
                        if name not in total:
                            total[name] = np.zeros(DIMS, dtype=np.int64)
                        total[name] += n[k * DIMS : (k + 1) * DIMS]
    width = DIMS // SLICES
    for name, n in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * SLICES), pa.array(range(SLICES), pa.int32()), pa.array([n[s * width : (s + 1) * width].astype("<i8").tobytes() for s in range(SLICES)])], names=["lang", "slice", "n"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for lang, s, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            n = np.frombuffer(n, dtype="<i8")
            total[lang, s] = total[lang, s] + n if (lang, s) in total else n
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()), pa.array([n.tobytes() for n in total.values()], pa.binary())], names=["lang", "slice", "n"])


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """``docs`` (text, lang, ...) -> languages in order, and their log-probabilities of the columns (languages x DIMS)."""
    ddl = "lang string, slice int, n binary"
    own = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = own.mapInArrow(_train, ddl).repartition(min(SLICES, partitions(docs.sparkSession)), "slice").mapInArrow(_add, ddl).toPandas()
    langs = sorted(set(rows["lang"]))
    n = np.zeros((len(langs), DIMS))
    width = DIMS // SLICES
    for lang, s, x in rows.itertuples(index=False):
        n[langs.index(lang), s * width : (s + 1) * width] += np.frombuffer(x, dtype="<i8")
    n += SMOOTH
    return langs, np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)


def _predict(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        padded = np.concatenate([table, np.zeros((len(langs), 1), dtype=np.float32)], axis=1) if langs else table
        for whole in batches:
            for batch in parts(whole, "text"):
                points, offsets = _points(batch.column(1))
                n = batch.num_rows
                total, grams, letters = np.zeros((n, len(langs))), np.zeros(n), np.zeros(n, dtype=np.int64)
                for lo in range(0, len(points), SEGMENT):
                    hi = min(lo + SEGMENT + ORDERS - 1, len(points))
                    a, z = np.searchsorted(offsets, lo, side="right") - 1, np.searchsorted(offsets, min(lo + SEGMENT, len(points)))
                    cut = np.maximum(offsets[a:z], lo) - lo
                    letters[a:z] += np.add.reduceat(_LETTER[points[lo : min(lo + SEGMENT, len(points))]], cut, dtype=np.int64)
                    for f in _features(points[lo:hi]):
                        f = f[:SEGMENT]
                        own = np.searchsorted(cut, len(f))
                        grams[a : a + own] += np.add.reduceat(f >= 0, cut[:own], dtype=np.int64)
                        for k in range(len(langs)):
                            total[a : a + own, k] += np.add.reduceat(padded[k][f], cut[:own], dtype=np.float64)
                yield from _rows(batch, langs, total, grams, letters)

    return run


def _rows(batch: pa.RecordBatch, langs: list[str], total: np.ndarray, grams: np.ndarray, letters: np.ndarray) -> Iterator[pa.RecordBatch]:
    und = letters == 0
    if langs:
        mean = total / np.maximum(grams, 1)[:, None]
        best = mean.argmax(axis=1)
        odds = np.exp(SHARP * (mean - mean.max(axis=1, keepdims=True)))
        share = 1 / odds.sum(axis=1)
        name = np.array([*langs, "und"], dtype=object)[np.where(und, len(langs), best)]
    else:
        name, share = np.full(len(und), "und", dtype=object), np.zeros(len(und))
        und = np.ones(len(und), dtype=bool)
    yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != 1), pa.array(name, pa.string()), pa.array(np.where(und, 0.0, share))], names=[*(batch.schema.names[i] for i in range(batch.num_columns) if i != 1), "lang_pred", "score"])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *more: Column) -> DataFrame:
    """doc_id, ``more`` columns, lang_pred, score of each row of ``docs`` (doc_id, text, ...)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", lang_pred string, score double"
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), ddl)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = held_out(F.col("doc_id"))
    return predict(docs, fit(docs.filter(~held)), held.alias("held_out")).select("doc_id", "held_out", "lang_pred", "score")
