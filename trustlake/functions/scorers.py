"""Classifiers under test. A scorer turns a text column into a prediction; callers bring their own.

``TokenWeightScorer`` is a linear model over words, all column expressions;
``PipelineScorer`` wraps a Spark ML model; ``BatchScorer`` a Python function on
Arrow batches, whose model each task loads once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlake.functions.portable import ascii_words


class TokenWeightScorer:
    """Sum of whole-number word weights; positive is class 1. ``weight`` maps a token column to a bigint column."""

    def __init__(self, weight: Callable[[Column], Column], bias: int = 0, scale: float = 1000.0) -> None:
        self.weight, self.bias, self.scale = weight, bias, scale

    def total(self, text: Column) -> Column:
        return F.aggregate(ascii_words(text), F.lit(self.bias).cast("bigint"), lambda a, w: a + self.weight(w))

    def pred(self, text: Column) -> Column:
        return (self.total(text) > 0).cast("int")

    def prob(self, text: Column) -> Column:
        return 1 / (1 + F.exp(-self.total(text) / self.scale))

    def __call__(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        return df.withColumn("pred", self.pred(F.col(text_col))).withColumn("prob", self.prob(F.col(text_col)))


def table_weights(weights: dict[str, int]) -> Callable[[Column], Column]:
    """Weights of a bounded vocabulary, 0 for other words."""
    pairs = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, v)))
    return lambda w: F.coalesce(F.try_element_at(pairs, w), F.lit(0)).cast("bigint")


def hashed_weights(spread: int = 201) -> Callable[[Column], Column]:
    """Weights of any vocabulary: whole numbers around 0 from the word's md5."""
    return lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 6), 16, 10).cast("bigint") % spread - spread // 2


class PipelineScorer:
    """A fitted Spark ML pipeline with ``prediction`` and ``probability`` columns."""

    def __init__(self, model) -> None:
        self.model = model

    def __call__(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(df if text_col == "text" else df.withColumn("text", F.col(text_col)))
        return out.withColumn("pred", F.col("prediction").cast("int")).withColumn("prob", vector_to_array("probability")[1])


class BatchScorer:
    """``load`` returns a function from a pandas series of texts to probabilities of class 1."""

    def __init__(self, load: Callable[[], Callable[[pd.Series], pd.Series]]) -> None:
        self.load = load

    def __call__(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        load = self.load

        @F.pandas_udf(T.DoubleType())
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for text in parts:
                yield model(text)

        return df.withColumn("prob", score(F.col(text_col))).withColumn("pred", (F.col("prob") > 0.5).cast("int"))
