"""Scoring of streams, and linear fits that grow with them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from ..frame import MultiviewFrame
from ..plans.gram import gram, merged


def score_stream(model, stream: DataFrame, like: MultiviewFrame) -> DataFrame:
    """Scores of a streaming table with the columns of ``like``; linear models are stateless projections."""
    out = model.transform(replace(like, df=stream))
    return out.df if isinstance(out, MultiviewFrame) else out


class RunningGram:
    """Counts, means and scatter that take in micro-batches: use ``update`` in foreachBatch."""

    def __init__(self, like: MultiviewFrame):
        self.like, self.gram = like, None

    def update(self, batch: DataFrame, _epoch: int = 0) -> None:
        if batch.isEmpty():
            return
        self.gram = merged(self.gram, gram(replace(self.like, df=batch)))
