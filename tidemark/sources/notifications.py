"""Change notifications: which stream got which event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import stream_of_inbox
from tidemark.model import NOTIFICATION_SCHEMA


def parse_notifications(bodies: DataFrame, col: str = "body") -> DataFrame:
    return bodies.select(F.from_json(col, NOTIFICATION_SCHEMA).alias("_n")).select("_n.*")


def route_notifications(notifications: DataFrame) -> DataFrame:
    """Additions only: the stream whose inbox got the event, and where the event is."""
    return notifications.where(F.col("type") == "Add").select(
        stream_of_inbox("target").alias("stream"), F.col("object").alias("location")
    )
