"""Mixing sources to target weights by pivotal dependent rounding. DataFrame and SQL functions only."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop_table, few_files, need, table

EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds ``target`` to (skey, source, source_size): the share by weight, capped at ``most`` times
    the source's size, what is above it being shared again among the others until none is above.

    Sources are ranked by a range partitioning and the partitions' offsets, not in one task."""
    order = F.col("source").asc_nulls_last()
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = table(few_files(sizes.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id())), "sources")
    before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row a partition of the range
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("before")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = ranged.join(before, "part").withColumn("weight", F.get(cycle, (rank % len(weights)).cast("int")))
    ranked = table(few_files(ranked.drop("part", "before").withColumn("cap", F.col("source_size") * F.lit(float(most)))), "weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("cap")
        one = ranked.agg(F.sum(F.when(above, 1).otherwise(0)), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if (one[0] or 0) == capped or not one[2]:
            break
        capped, level = one[0] or 0, (share * total - (one[1] or 0.0)) / one[2]
    by_weight = F.col("weight") * F.lit(level if level is not None else 0.0)
    return ranked.withColumn("target", F.least(by_weight, F.col("cap")))


def _done(row: str, f: str) -> str:
    return f"named_struct('rid', {row}.rid, 'copy', cast(round({f}) as int), 'size', {row}.size, 'id', {row}.id)"


#: One pairing. The carried row i and the next row j move words between them until one of them is
#: integral; the sum of fraction times size stays, and either way is taken with the probability that keeps each
#: fraction's expectation.
_PAIR = f"""
transform(
  transform(
    transform(array(x.size / acc.carry.size), r -> named_struct('r', r, 'up', least(1 - acc.carry.f, x.f * r), 'down', least(acc.carry.f, (1 - x.f) * r))),
    m -> named_struct(
      'i', if(x.u * (m.up + m.down) < m.down, acc.carry.f + m.up, acc.carry.f - m.down),
      'j', if(x.u * (m.up + m.down) < m.down, x.f - m.up / m.r, x.f + m.down / m.r))),
  f -> CASE
    WHEN (f.i < {EPS} OR f.i > 1 - {EPS}) AND (f.j < {EPS} OR f.j > 1 - {EPS}) THEN
      named_struct('carry', NONE, 'done', concat(acc.done, array({_done("acc.carry", "f.i")}, {_done("x", "f.j")})))
    WHEN f.i < {EPS} OR f.i > 1 - {EPS} THEN
      named_struct('carry', named_struct('size', x.size, 'id', x.id, 'rid', x.rid, 'f', f.j, 'u', x.u), 'done', concat(acc.done, array({_done("acc.carry", "f.i")})))
    ELSE
      named_struct('carry', named_struct('size', acc.carry.size, 'id', acc.carry.id, 'rid', acc.carry.rid, 'f', f.i, 'u', acc.carry.u), 'done', concat(acc.done, array({_done("x", "f.j")})))
  END)[0]
"""


def _flips(rows: DataFrame, error: DataFrame, rounds: int = 4) -> DataFrame:
    """(rid, flip): rounded rows that get one copy more or less, to make up for the ``error`` in words
    (skey, e) that rounding a source's last row leaves.

    Each round takes, in every source, the row that brings its words nearest to the target from the other
    side or from this one; what the nearest of all rounds had is returned. Rows of one source, copy
    and size are alike, so one of them stands for all and what is searched grows with the number of
    sizes, not of documents. The state is one row a source."""
    kinds = table(few_files(rows.groupBy("skey", "copy", "size").agg(F.min(F.struct("id", "rid")).alias("row"))), "kinds")
    flip = F.struct(F.col("best.row.rid").alias("rid"), (1 - 2 * F.col("best.copy")).alias("flip"))
    none = F.array().cast("array<struct<rid: bigint, flip: int>>")
    now = table(error.select("skey", "e", none.alias("used"), F.struct(F.abs("e").alias("far"), none.alias("used")).alias("nearest")), "flips")
    for _ in range(rounds):
        after = F.col("e") - F.signum("e") * F.col("size")
        fits = (F.abs("e") >= 0.5) & (F.col("copy") == F.when(F.col("e") > 0, 1).otherwise(0)) & ~F.array_contains("used.rid", F.col("row.rid"))
        best = kinds.join(now.select("skey", "e", "used"), "skey").where(fits)
        best = best.groupBy("skey").agg(F.min(F.struct(F.abs(after).alias("far"), "size", "copy", "row", after.alias("e"))).alias("best"))
        moved = F.col("best").isNotNull()
        nxt = now.join(best, "skey", "left").select("skey", F.when(moved, F.col("best.e")).otherwise(F.col("e")).alias("e"), F.when(moved, F.array_append("used", flip)).otherwise(F.col("used")).alias("used"), "nearest")
        nxt = table(few_files(nxt.withColumn("nearest", F.least("nearest", F.struct(F.abs("e").alias("far"), F.col("used").alias("used"))))), "flips")
        drop_table(now)
        now = nxt
    drop_table(kinds)
    return now.select(F.explode("nearest.used").alias("o")).select("o.*")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    fan_in: int = 128,
    payload: list[str] | None = None,
) -> DataFrame:
    """How often each document goes into a mix whose sources have given weights.

    A document's size is its number of words. Sources in code point order (null last) take their
    weights from ``weights``, repeating, and share ``share`` times all words; no target is above
    ``most`` times its source. A document's expected number of copies is its source's target / size; the
    fractional part is rounded dependently: in groups of about ``fan_in`` rows of one source, longest first, rows
    are paired and words moved from one to the other at random until one is integral, so the source's sum of
    words never changes. Each group leaves at most one fractional row, and those are grouped
    again, level by level, until a source has one; that one is rounded to the nearest. That leaves an error
    of at most half of one document, and up to four other rows, of the sizes nearest to it, get a copy
    more or less to make it small (_flips). Random numbers are hashes of id, size, level and ``seed``: reruns agree.

    Returns for each row: id (named ``id_col``), size, source_size, target, copies, taken and a
    struct ``payload`` of the named columns (if any). Null texts have size 0; documents of size 0
    are never taken. Null ids and repeated rows are documents like any other. An empty table gives an empty result.
    """
    need(docs, id_col, text_col, source_col, *(payload or []))
    kind = docs.schema[id_col].dataType.simpleString()
    cols = [F.struct(*(F.col(f"`{c}`") for c in payload)).alias("payload")] if payload else []
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col(f"`{source_col}`").cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("skey"), source.alias("source"), size.alias("size"), F.monotonically_increasing_id().alias("rid"), *cols
    )
    rows = table(rows, "sizes")
    sizes = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    targets = table(few_files(source_targets(sizes, weights, share, most)), "targets").select("skey", "source_size", "target", "n")
    want = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    base = F.floor(want + EPS)
    frac = F.when((F.col("size") > 0) & (want - base > EPS), want - base).otherwise(0.0)
    live = rows.select("id", "skey", "size", "rid").join(targets, "skey").select("id", "skey", "size", "rid", "n", frac.alias("f")).where("f > 0").drop("f")
    fraction = targets.select("skey", (want - base).alias("f"))
    level, done = 0, []
    item = f"struct<size: bigint, id: {kind}, rid: bigint, f: double, u: double>"
    ended = f"struct<rid: bigint, copy: int, size: bigint, id: {kind}>"
    pair = _PAIR.replace("NONE", f"cast(null as {item})")
    now = live.join(fraction, "skey")
    while True:
        # groups by hash, each cut again where many rows hash alike
        groups = F.pmod(F.xxhash64("id", "size", F.lit(seed + level)), F.greatest(F.ceil(F.col("n") / fan_in), F.lit(1)))
        place = Window.partitionBy("skey", "g").orderBy("id", "size", "rid")
        uniform = F.shiftrightunsigned(F.xxhash64("id", "size", F.lit(level), F.lit(seed)), 11) * F.lit(2.0**-53)
        dealt = now.withColumn("g", groups).withColumn("cut", F.floor((F.row_number().over(place) - 1) / (4 * fan_in)))
        dealt = dealt.withColumn("item", F.struct("size", "id", "rid", "f", uniform.alias("u")))
        grouped = dealt.groupBy("skey", "g", "cut").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        ran = grouped.select(
            "skey",
            F.expr(
                f"""aggregate(items, named_struct('carry', cast(null as {item}), 'done', cast(array() as array<{ended}>)),
                (acc, x) -> if(acc.carry IS NULL, named_struct('carry', x, 'done', acc.done), {pair}))"""
            ).alias("r"),
        )
        ended_rows = F.transform("r.done", lambda d: F.struct(d.alias("done"), F.lit(None).cast(item).alias("carry")))
        carried = F.expr(f"if(r.carry IS NULL, cast(array() as array<struct<done: {ended}, carry: {item}>>), array(named_struct('done', cast(null as {ended}), 'carry', r.carry)))")
        ran = table(few_files(ran.select("skey", F.explode(F.concat(ended_rows, carried)).alias("o")).select("skey", "o.*")), f"round{level}")
        left = ran.where("carry IS NOT NULL").groupBy("skey").agg(F.count(F.lit(1)).alias("n"))
        most_left = left.agg(F.max("n")).first()[0] or 0
        done.append(ran.where("carry IS NULL").select("skey", "done.*"))
        if most_left <= 1:
            break
        now = ran.where("carry IS NOT NULL").select("skey", "carry.id", "carry.size", "carry.rid", "carry.f").join(left, "skey")
        level += 1
    last, f = ran.where("carry IS NOT NULL"), F.col("carry.f")
    rounded = last.select("skey", "carry.rid", F.round(f).cast("int").alias("copy"), "carry.size", "carry.id")
    for d in done:
        rounded = rounded.union(d)
    flips = _flips(rounded, last.select("skey", ((F.round(f) - f) * F.col("carry.size")).alias("e")))
    extra = rounded.select("rid", "copy")
    added = F.coalesce("copy", F.lit(0)) + F.coalesce("flip", F.lit(0))
    copies = F.when(F.col("size") > 0, base + added).otherwise(0).cast("long")
    out = rows.join(targets, "skey").join(extra, "rid", "left").join(flips, "rid", "left").withColumn("copies", copies)
    return few_files(out).select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *(["payload"] if payload else []))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params: object) -> DataFrame:
    """The rows of ``docs`` as often as mix_sources takes them, with all their columns."""
    out = mix_sources(docs, id_col, text_col, source_col, payload=docs.columns, **params).where("copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*(F.col("payload")[c].alias(c) for c in docs.columns))
