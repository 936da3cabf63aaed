"""What the operators of this subpackage share: shared-folder tables, safe columns and splits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and the bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names, else the warehouse; where
    all run on one machine, a temporary folder will do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        alone = spark.sparkContext.master.startswith("local")
        named = f"{tempfile.gettempdir()}/letterloom-shared" if alone else spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


#: Bytes of the tables it is made from that a file of few_files stands for, and the files a core that there may be in any case.
FILE_BYTES, FILES_A_CORE = 1 << 24, 2


def few_files(df: DataFrame) -> DataFrame:
    """``df`` in no more partitions than its size calls for. Hadoop's local files start a process for each file that a
    task writes and for its checksum (chmod), and until that runs its own program it shows all of the executor's memory
    as its own; a partition for each of many shuffle partitions makes thousands of them.

    The tables that ``df`` is made from tell the size, so partitions grow in number with the input; where
    no size is known all stay. Not for rows that come from Python or that a task numbers by itself."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    made_from = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    most = max(FILES_A_CORE * spark.sparkContext.defaultParallelism, -(-made_from // FILE_BYTES))
    return df.coalesce(most) if most < 1 << 31 else df


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends here, and a lost
    executor costs no more than the tasks that it ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/letterloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._letterloom_path = path
    return out


def drop_table(df: DataFrame | None) -> None:
    """Deletes what table() wrote, once nothing reads it any more."""
    path = getattr(df, "_letterloom_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def join_groups(rows: DataFrame, groups: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Rows (with a number ``rid`` of their own) with the columns of their group: one row for each value
    of ``keys``, with its number of rows n.

    Groups of more rows than an even share of a task are salted: there are no more of them than tasks, so
    they are broadcast; their rows are dealt out, and the group's one row is repeated for each salt. Rows
    without a key have no group and are dealt out too."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(rows.count() // parts, 1)
    hot = groups.where(F.col("n") > share).groupBy(F.xxhash64(*keys).alias("short")).agg(F.max(F.ceil(F.col("n") / share)).alias("salts"))
    # groups of one hash that are not hot only get more salts than they need
    salted = lambda df: df.withColumn("short", F.xxhash64(*keys)).join(F.broadcast(hot), "short", "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("long"))).drop("short")
    lone = F.greatest(*(F.col(k).isNull() for k in keys), F.lit(False))
    rows = salted(rows).withColumn("salt", F.pmod(F.xxhash64("rid"), F.when(lone, F.lit(parts).cast("long")).otherwise(F.col("salts")))).drop("salts")
    groups = salted(groups).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return rows.join(groups, [*keys, "salt"], how).drop("salt")


def is_held_out(id_col: Column | str) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 4 == 2


#: Rows of an Arrow batch: with whole texts in them, more would make a worker's memory.
BATCH_ROWS = 1000


def need(df: DataFrame, *names: str) -> None:
    """Checks that the columns are there, and bounds the Arrow batches of the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
