"""Serving: a stream of queries against a static model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.smoothing import BackoffModel


def score_stream(queries: DataFrame, model: BackoffModel) -> DataFrame:
    """A stream or table of (ctx, w0) with p: the same stream-static left joins either way, so no state is kept."""
    return model.prob(queries, "p")
