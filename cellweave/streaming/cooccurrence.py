"""Co-occurrence over a stream of molecules.

Counts of (context, feature) are additive, so a stream updates them; association is a
query on their current state, as it is on a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators import stats


def counts(stream: DataFrame, context: str = "cell_id", gene: str = "feature_name", watermark: tuple[str, str] | None = None, window: str | None = None) -> DataFrame:
    """(context, gene, n) kept by the stream; with a watermark (column, delay) and window, per window of event time."""
    if watermark is not None:
        stream = stream.withWatermark(*watermark)
    keys = [context, gene] + ([F.window(watermark[0], window).alias("window")] if watermark is not None and window else [])
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))


def npmi_of_counts(state: DataFrame, context: str = "cell_id", gene: str = "feature_name", min_count: int = 2, **options) -> DataFrame:
    """Association from counts (context, gene, n)."""
    return stats.npmi(state, context, gene, min_count, count_col="n", **options)
