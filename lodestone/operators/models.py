"""Injected models as batch functions: encoders and rerankers run over Arrow batches and load once per task; no model ships with the engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Scorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]


def encode(rows: DataFrame, load: Callable[[], Encoder], text: str = "text", out: str = "vector", batch: int = 64) -> DataFrame:
    """rows with the encoder's vectors of a text column; null texts are encoded as empty."""

    @F.pandas_udf("array<double>")
    def vectors(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for series in it:
            texts = series.fillna("").tolist()
            yield pd.Series([list(map(float, v)) for at in range(0, len(texts), batch) for v in model(texts[at : at + batch])])

    return rows.withColumn(out, vectors(F.col(text)))


def score(pairs: DataFrame, load: Callable[[], Scorer], query: str = "query", text: str = "text", out: str = "rerank_score", batch: int = 64) -> DataFrame:
    """pairs with the reranker's scores."""

    @F.pandas_udf("double")
    def scores(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in it:
            q, t = q.fillna("").tolist(), t.fillna("").tolist()
            yield pd.Series([float(s) for at in range(0, len(q), batch) for s in model(q[at : at + batch], t[at : at + batch])])

    return pairs.withColumn(out, scores(F.col(query), F.col(text)))
