"""Parsing messages as they arrive."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.messages import parse_messages
from ..plans.message import ParseOptions


def parse_stream(stream: DataFrame, raw: str = "raw", options: ParseOptions | None = None) -> DataFrame:
    """Parsing keeps no state, so a stream of raw messages is parsed as a table is."""
    parsed = parse_messages(stream, raw, options)
    return parsed.withColumn("date_ts", F.try_to_timestamp(F.col("message.date")))


def counts_by_window(parsed: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Messages by time of their date header and sender, with a watermark."""
    rows = parsed.withWatermark("date_ts", late)
    return rows.groupBy(F.window("date_ts", window).alias("window"), F.col("message.from.address").alias("sender")).agg(F.count(F.lit(1)).alias("messages"))


def write_stream(parsed: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """To parquet, each message exactly once; ``checkpoint`` must be a folder that all machines share."""
    writer = parsed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all machines share: what spark.checkpoint.dir names, else the warehouse, or a
    temporary one where all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = tempfile.gettempdir() if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    return f"{named.rstrip('/')}/letterloom/{name}-{uuid.uuid4().hex}"
