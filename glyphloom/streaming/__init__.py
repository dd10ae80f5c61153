"""Structured Streaming: analysis is stateless by document, so it runs as a map; rates are a windowed aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.operators.analysis import Deployment, read_documents, resolve


def stream_findings(stream: DataFrame, profile: str = "general-writing", input_format: str = "markdown", deployment: Deployment = Deployment(), time_column: str | None = None) -> DataFrame:
    """Findings of a stream of (doc_id, text[, time]) rows; no state is kept, and ``time_column`` goes along for ``family_counts``."""
    times = (time_column,) if time_column else ()
    read = read_documents(stream, profile, input_format, deployment, want=("hits",), passing=times)
    return resolve(read.where("status = 'ok'").select("doc_id", "profile", "word_count", *times, F.inline("hits")), deployment).select(
        "doc_id", *times, "rule_id", "family", "state", "lifecycle", "start", "end", "snippet"
    )


def family_counts(stream: DataFrame, time_column: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Findings by family in event-time windows, late rows accepted up to the watermark."""
    return stream.withWatermark(time_column, late).groupBy(F.window(time_column, window), "family").agg(F.count("*").alias("findings"))
