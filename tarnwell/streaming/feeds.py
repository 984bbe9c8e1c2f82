"""Structured Streaming over the ledger and the event table. The batch operators are the reference semantics; streams are an addition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.ledger import entry_hash


def broken_entries(ledger: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Entries, of a stream or a table, whose own hash is not what their fields give: a check that needs no other row."""
    text = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("None")) for f in fields])
    return ledger.where(~F.coalesce(F.col("entry_hash") == entry_hash(F.col("seq"), text, F.col("prev_hash")), F.lit(False)))


def event_rates(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per type and window; windows close once the watermark has passed them."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "w.end", "event_type", "n")


def append_to(stream: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends a stream to Parquet exactly once and stops when all that is there has been read."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
