"""What parsing costs must not grow faster than the tables: work a message, tasks, and memory of a worker."""

import pickle
import time

from pyspark import cloudpickle
from pyspark.sql import functions as F

from letterloom.functions import columns as C
from letterloom.functions.addresses import parse_addresses
from letterloom.functions.dates import iso_date, shown_date
from letterloom.functions.memo import Memo
from letterloom.operators import messages as M
from letterloom.plans.message import MESSAGE_FIELDS, MessageError, ParseOptions, parse_message

FORWARDED = b'Subject: outer\r\nContent-Type: message/rfc822\r\n\r\nFrom: "R&D" <a@b.test>\r\nTo: a@b.test, team: B <b@b.test>;\r\nSubject: <x>\r\nDate: Fri, 5 Mar 1993 10:00:00 +0200\r\n\r\ninner\r\n'
PARTS = b"Content-Type: multipart/mixed; boundary=A\r\n\r\n--A\r\nContent-Type: text/html\r\n\r\n<b>x</b>\r\n--A\r\nContent-Type: image/gif\r\n\r\nGIF\r\n--A--"


def test_named_fields_are_those_of_the_whole_message():
    for raw in (FORWARDED, PARTS, b"", b"Subject: x\n\n"):
        whole = parse_message(raw)
        assert tuple(whole) == MESSAGE_FIELDS
        for name in MESSAGE_FIELDS:
            assert parse_message(raw, None, [name]) == {name: whole[name]}
    try:
        parse_message(FORWARDED, ParseOptions(max_headers_size=60), ["attachments"])
    except MessageError as e:
        assert "header size" in str(e)
    else:
        raise AssertionError("limits hold for all fields")


def test_parse_messages_makes_the_named_fields_only(spark):
    rows = spark.createDataFrame([(1, bytearray(FORWARDED))], "id long, raw binary")
    p = M.parse_messages(rows, fields=["html"])
    assert p.schema["message"].dataType.names == ["html"]
    assert p.select("message.html").first()[0] == parse_message(FORWARDED)["html"]


def test_a_forwarded_message_makes_only_the_text_that_is_asked_for():
    # texts of ten nested messages were made again at every level, and headers that none shows were parsed
    raw = b"Content-Type: message/rfc822\r\n\r\n" * 10 + b"Content-Type: text/html\r\n\r\n" + b"<p>a</p>\r\n" * 20_000
    start = time.process_time()
    parse_message(raw, None, ["html"])
    one = time.process_time() - start
    start = time.process_time()
    parse_message(b"Content-Type: text/html\r\n\r\n" + b"<p>a</p>\r\n" * 20_000)
    assert one < 10 * (time.process_time() - start)


def test_plain_mailboxes_and_dates_read_as_the_others():
    assert parse_addresses('"R&D 5" <c5@shop.test>') == parse_addresses(' "R&D 5" <c5@shop.test> ') == [{"name": "R&D 5", "address": "c5@shop.test", "group": None}]
    assert parse_addresses("a@b.test") == parse_addresses(" a@b.test") == [{"name": "", "address": "a@b.test", "group": None}]
    start = time.process_time()
    parse_addresses("x" + " " * 50_000 + "y" * 50_000)
    assert time.process_time() - start < 5
    assert iso_date("Fri, 5 Mar 1993 01:00:00 +0200") == iso_date("5 Mar 1993 01:00:00 +0200 (CEST)") == "1993-03-04T23:00:00.000Z"
    assert shown_date("1993-03-31T23:00:00.000Z") == shown_date("1993-03-31T23:00:00Z") == "3/31/1993, 23:00:00"
    assert iso_date("30 Feb 1993 01:00:00 +0000") == "30 Feb 1993 01:00:00 +0000"
    # what is kept is not what callers get
    found = parse_addresses("a@b.test, c@d.test")
    found[0]["name"] = "changed"
    assert parse_addresses("a@b.test, c@d.test")[0]["name"] == ""


def test_memo_is_bounded_and_pickled():
    m = pickle.loads(cloudpickle.dumps(Memo(lambda x: x + 1, 3)))
    assert [m[i] for i in range(10)] == list(range(1, 11)) and len(m) <= 3


def test_tasks_grow_with_the_table(spark, tmp_path, monkeypatch):
    spark.range(400_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s")).coalesce(1).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert M.spread(t).rdd.getNumPartitions() >= size // M.TASK_BYTES > 4
    assert M.spread(spark.range(10)).rdd.getNumPartitions() == 4


def _largest_batch(df):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    return df.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


def test_arrow_batches_are_bounded_by_their_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    texts = spark.range(2000, numPartitions=1).select("id", F.repeat(F.lit("x"), F.lit(20_000)).alias("text"))
    try:
        spark.conf.set(key, "1g")
        assert _largest_batch(texts) > 30 << 20
        M.spread(texts)
        assert _largest_batch(texts) < 2 * C.ARROW_BYTES
        spark.conf.set(key, "1g")
        C.html_to_text("text")
        assert spark.conf.get(key) == str(C.ARROW_BYTES)
        # a lower bound stays
        spark.conf.set(key, "1m")
        M.spread(texts)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)


def test_results_are_handed_on_in_small_batches(spark):
    rows = spark.range(3000, numPartitions=1).select("id", F.encode(F.concat(F.lit("Subject: x\r\n\r\n"), F.repeat(F.lit("x"), F.lit(4000))), "UTF-8").alias("raw"))
    p = M.parse_messages(rows.coalesce(1), fields=["text"])

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    assert p.count() == 3000
    assert M.BATCH_BYTES <= 1 << 20 and p.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 16 << 20
