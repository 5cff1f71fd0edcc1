"""Finding the streams that carry a metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import RELATES_TO_PROPERTY, TREE_VIEW


def _relates(metrics: Sequence[str]):
    return (F.col("p") == RELATES_TO_PROPERTY) & F.col("o").isin(*metrics)


def find_streams(type_index: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """All views of every pod whose index relates to one of the metrics, not only the view that does."""
    hits = type_index.where(_relates(metrics)).select("pod").distinct()
    views = type_index.where(F.col("p") == TREE_VIEW).select("pod", F.col("o").alias("stream"))
    return views.join(hits, "pod", "left_semi")


def locate_stream(type_index: DataFrame, metric: str, seq: str = "seq") -> DataFrame:
    """Per pod: the first subject related to the metric, else its first view, else empty."""
    related, view = _relates([metric]), F.col("p") == TREE_VIEW
    found = type_index.where(related | view).groupBy("pod").agg(
        F.coalesce(
            F.min_by(F.when(related, F.col("s")), F.when(related, F.col(seq))),
            F.min_by(F.when(view, F.col("o")), F.when(view, F.col(seq))),
        ).alias("stream")
    )
    return type_index.select("pod").distinct().join(found, "pod", "left")


def exists_metric(type_index: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return type_index.groupBy("pod").agg(F.bool_or(_relates(metrics)).alias("relevant"))
