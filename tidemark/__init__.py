"""Continuous aggregation over timestamped RDF observation streams, on Spark."""

from tidemark.model import Agg, ContinuousQuery, Pattern, WindowSpec
from tidemark.session import build_session, prepare

__all__ = ["Agg", "ContinuousQuery", "Pattern", "WindowSpec", "build_session", "prepare"]
