"""Parsing a column of raw messages, and tables of what is in them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import schemas
from ..functions.columns import bound_batches, flat_addresses
from ..plans.message import ParseOptions, parse_header_block, parse_message, parse_parts

#: Of raw messages parsed together; of a table that one task gets; of a table, for each core, from which on it isn't dealt out.
BATCH_BYTES, TASK_BYTES, SPREAD_BYTES = 1 << 20, 2 << 20, 256 << 20
#: Messages parsed together.
BATCH_ROWS = 1000


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a table out to all cores: parsing is work of its own, and a small file may be a single split,
    or a few that hold many short rows. The number of tasks grows with the table, by TASK_BYTES of Spark's estimate of it.
    A table of more than SPREAD_BYTES a core has splits enough, and is not shuffled."""
    bound_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = 0 if df.isStreaming else int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if df.isStreaming or size > cores * SPREAD_BYTES:
        return df
    return df.repartition(cores * max(1, -(-size // (cores * TASK_BYTES))))


def _parsed(df: DataFrame, raw: str, kind: str | T.StructType, run: Callable, options: ParseOptions, mode: str, out: str) -> DataFrame:
    """One Arrow pass over the rows: adds ``out`` and ``_error`` to the columns."""
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError("mode: PERMISSIVE or FAILFAST")
    clash = {out, "_error"} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    data = F.col(f"`{raw}`").cast("binary")
    rows = spread(df).withColumn("__raw", data)
    result = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    schema = T.StructType([*df.schema.fields, T.StructField(out, result), T.StructField("_error", T.StringType())])
    arrow = to_arrow_schema(T.StructType([T.StructField(out, result)])).field(out).type

    def batches_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < len(batch):
                # results of large messages are handed on before more are parsed
                values, errors, size, start = [], [], 0, at
                while at < len(batch) and at - start < BATCH_ROWS and size < BATCH_BYTES:
                    data = batch.column("__raw")[at].as_py()
                    at += 1
                    size += len(data or b"")
                    try:
                        values.append(run(data, options))
                        errors.append(None)
                    except MemoryError:
                        raise
                    except Exception as e:
                        if mode == "FAILFAST":
                            raise
                        values.append(None)
                        errors.append(str(e) if isinstance(e, ValueError) else f"{type(e).__name__}: {e}")
                part = batch.slice(start, at - start).drop_columns(["__raw"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, arrow), pa.array(errors, pa.string())], [*part.schema.names, out, "_error"])

    return rows.mapInArrow(batches_, schema)


def parse_messages(df: DataFrame, raw: str = "raw", options: ParseOptions | None = None, mode: str = "PERMISSIVE", out: str = "message", fields: Sequence[str] | None = None) -> DataFrame:
    """Adds the parsed message as a struct and ``_error``: why a message was refused (its struct is null then).
    A null message counts as empty. FAILFAST ends the query at the first refused message. With ``fields`` the
    struct has only those, and no others are made; the whole message is read all the same."""
    known = T._parse_datatype_string(f"struct<{schemas.MESSAGE}>")
    names = list(fields) if fields is not None else known.names
    kind = T.StructType([known[n] for n in names])
    return _parsed(df, raw, kind, lambda data, o: parse_message(data, o, names), options or ParseOptions(), mode, out)


def parse_headers(df: DataFrame, raw: str = "raw", options: ParseOptions | None = None, mode: str = "PERMISSIVE", out: str = "message", fields: Sequence[str] | None = None) -> DataFrame:
    """As parse_messages, without bodies and attachments: nothing behind the header is read. With
    ``fields`` the struct has only those, and no others are made."""
    known = T._parse_datatype_string(f"struct<{schemas.HEADER_FIELDS}>")
    names = list(fields) if fields is not None else known.names
    kind = T.StructType([known[n] for n in names])
    return _parsed(df, raw, kind, lambda data, o: parse_header_block(data, o, names), options or ParseOptions(), mode, out)


def parse_part_trees(df: DataFrame, raw: str = "raw", options: ParseOptions | None = None, mode: str = "PERMISSIVE", out: str = "parts") -> DataFrame:
    """Adds the parts of each message as an adjacency list."""
    return _parsed(df, raw, schemas.PARTS, parse_parts, options or ParseOptions(), mode, out)


# ---- tables ----


def headers_table(parsed: DataFrame, *keys: str) -> DataFrame:
    """A row for each header, with its place."""
    return parsed.select(*keys, F.posexplode("message.headers").alias("ordinal", "h")).select(*keys, "ordinal", "h.*")


def addresses_table(parsed: DataFrame, *keys: str) -> DataFrame:
    """A row for each mailbox of the fields that were parsed: role, place in its list, group's name (if any), name and address."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c)))
    there = parsed.schema["message"].dataType.names
    roles = [(r, one(f"message.{r}") if r in ("from", "sender") else F.col(f"message.{r}")) for r in ("from", "sender", "replyTo", "to", "cc", "bcc") if r in there]
    listed = F.array(*(F.struct(F.lit(r).alias("role"), c.alias("list")) for r, c in roles))
    rows = parsed.select(*keys, F.explode(listed).alias("r")).select(*keys, "r.role", F.posexplode("r.list").alias("ordinal", "a"))
    group = F.when(F.col("a.group").isNotNull(), F.col("a.name"))
    return rows.select(*keys, "role", "ordinal", group.alias("group_name"), F.explode(flat_addresses(F.array("a"))).alias("m")).select(*keys, "role", "ordinal", "group_name", "m.name", "m.address")


def attachments_table(parsed: DataFrame, *keys: str) -> DataFrame:
    """A row for each attachment, with its place and size in bytes."""
    rows = parsed.select(*keys, F.posexplode("message.attachments").alias("ordinal", "a")).select(*keys, "ordinal", "a.*")
    return rows.withColumn("size", F.octet_length("content").cast("long"))


def parts_table(trees: DataFrame, *keys: str) -> DataFrame:
    return trees.select(*keys, F.explode("parts").alias("p")).select(*keys, "p.*")


def header_bytes(trees: DataFrame, raw: str, *keys: str) -> DataFrame:
    """Bytes of header lines of each message's first header, by built-in functions."""
    head = F.substring_index(F.regexp_replace(F.decode(F.col(raw), "UTF-8"), "\r\n", "\n"), "\n\n", 1)
    return trees.select(*keys, F.octet_length(F.replace(head, F.lit("\n"), F.lit(""))).alias("header_bytes"))


def inline_images(parsed: DataFrame, *keys: str) -> DataFrame:
    """Images that HTML bodies refer to by cid, each with the first attachment of that content id (if any)."""
    cids = parsed.select(*keys, F.posexplode(F.regexp_extract_all("message.html", F.lit(r"""<img\b[^>]*\bsrc=["']?cid:([^"'\s>]+)"""), F.lit(1))).alias("image", "cid"))
    found = attachments_table(parsed, *keys).where("contentId IS NOT NULL").groupBy(*keys, "contentId")
    found = found.agg(F.min_by(F.struct("ordinal", "filename", "mimeType", "size"), "ordinal").alias("a"))
    on = [*(cids[k].eqNullSafe(found[k]) for k in keys), F.concat(F.lit("<"), cids["cid"], F.lit(">")) == found["contentId"]]
    return cids.join(found, on, "left").select(*(cids[k] for k in keys), "image", "cid", "a.ordinal", "a.filename", "a.mimeType", "a.size")


def unfold_headers(lines: DataFrame, order: str, line: str, *keys: str) -> DataFrame:
    """Folded header lines joined by built-in functions: one that begins with a space or tab goes on."""
    from pyspark.sql import Window

    starts = F.sum(F.when(F.col(line).rlike("^[ \\t]"), 0).otherwise(1)).over(Window.partitionBy(*keys).orderBy(order))
    groups = lines.withColumn("field", starts).groupBy(*keys, "field").agg(F.sort_array(F.collect_list(F.struct(order, line))).alias("l"))
    return groups.select(*keys, "field", F.array_join(F.transform("l", lambda x: x[line]), "").alias("unfolded"))


def is_report(mime: Column) -> Column:
    """Parts that make all forwarded messages attachments."""
    return mime.isin("message/delivery-status", "message/feedback-report")
