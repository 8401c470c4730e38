"""Event streams: classification without state, then the consent gate."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from sitelode.operators.events import classify
from sitelode.streaming.gate import gate_stream


def event_stream(interactions: DataFrame, consents: DataFrame, delay: str = "10 minutes", marks: DataFrame | None = None, **settings: Any) -> DataFrame:
    """The whole event job on streams; ``settings`` are those of ``gate_stream``."""
    return gate_stream(classify(interactions), consents, delay, marks, **settings)
