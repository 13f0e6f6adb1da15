"""Rates by period over a stream: the batch operator's counts, kept per window, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.features import quoted
from brindle.operators.target import rates_of_cells


def window_counts(stream: DataFrame, time: str, y: str, length: str = "1 day", late: str = "1 hour", by: list[str] = ()) -> DataFrame:
    """(start, end, by, rows, positives) of tumbling windows; rows later than ``late`` are left out."""
    rows = stream.select(quoted(time).cast("timestamp").alias("t"), quoted(y).cast("int").alias("y"), *[quoted(c) for c in by])
    counts = rows.withWatermark("t", late).groupBy(F.window("t", length).alias("w"), *[quoted(c) for c in by]).agg(F.count("*").alias("rows"), F.sum("y").cast("long").alias("positives"))
    return counts.select("w.start", "w.end", *by, "rows", "positives")


def rated(counts: DataFrame, overall: float | None = None) -> DataFrame:
    """Rates, intervals and support of finished windows; for a batch of a stream, or a table of them."""
    return rates_of_cells(counts, F.lit(overall).cast("double"))
