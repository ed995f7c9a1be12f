"""Triples as a stream: mapping, deduplication within a watermark, and counts by graph and window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.triples import COLUMNS


def deduplicated(triples: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    """First of equal triples within ``delay``; state is bounded by the watermark."""
    return triples.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(COLUMNS))


def counts(triples: DataFrame, time: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return triples.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), "g").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "g", "n")


def into_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Run over what there is and stop; for tests and catch-up runs."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
