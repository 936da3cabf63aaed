"""Messages from files and streams of files, and messages to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_eml(spark: SparkSession, path: str, glob: str = "*.eml", recursive: bool = False) -> DataFrame:
    """One row a file: path, modificationTime, length, raw. Filters on the first three reach the scan."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.withColumnRenamed("content", "raw")


def stream_eml(spark: SparkSession, path: str, glob: str = "*.eml", files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream of files that arrive."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.withColumnRenamed("content", "raw")


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages of mbox files: path, ordinal, raw. A line that begins with "From " after an empty one (or first) begins a message."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    pieces = F.split("value", r"(?:\A|(?<=\n\n)|(?<=\n\r\n))From [^\n]*\n")
    rows = text.select("path", F.posexplode(pieces).alias("ordinal", "m")).where("m <> ''")
    return rows.select("path", "ordinal", F.encode(F.regexp_replace("m", r"(?m)^>(>*From )", "$1"), "UTF-8").alias("raw"))


def from_text(df: DataFrame, column: str, out: str = "raw") -> DataFrame:
    """Text as the bytes of a message; null is an empty one."""
    return df.withColumn(out, F.coalesce(F.encode(F.col(column), "UTF-8"), F.lit(b"")))


def write_messages(parsed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parsed messages as parquet, attachments within."""
    parsed.write.mode(mode).parquet(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
