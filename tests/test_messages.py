import time

import pytest
from pyspark.sql import functions as F

from letterloom.functions import columns as C
from letterloom.operators import messages as M
from letterloom.plans.message import MessageError, ParseOptions, parse_message, parse_parts, unflow
from letterloom.sources import eml
from letterloom.streaming import messages as stream


def lines(*parts):
    return "\r\n".join(parts).encode()


def test_empty_and_header_only():
    m = parse_message(b"")
    assert m["headers"] == [] and m["text"] is None and m["attachments"] == []
    assert parse_message(b"Subject: x\n")["text"] is None and parse_message(None)["subject"] is None


def test_first_header_counts_even_if_empty():
    assert parse_message(b"Subject:\nSubject: b\n\n")["subject"] is None
    assert [a["address"] for a in parse_message(b"To: a@b\nTo: c@d\n\n")["to"]] == ["a@b", "c@d"]


def test_boundaries():
    raw = lines("Content-Type: multipart/mixed; boundary=A", "", "preamble", "--A", "", "one", "--AB", "--A  ", "", "two", "--A-- ", "after")
    assert parse_message(raw)["text"] == "one\n--AB\n\ntwo\n"
    nested = lines("Content-Type: multipart/mixed; boundary=A", "", "--A", "Content-Type: multipart/mixed; boundary=B", "", "--B", "", "in", "--A", "", "out")
    assert parse_message(nested)["text"] == "in\n\nout\n"


def test_bodies_are_made_from_the_other_kind():
    raw = lines("Content-Type: multipart/mixed; boundary=A", "", "--A", "Content-Type: text/html", "", "<b>x</b>", "--A", "", "y", "--A--")
    m = parse_message(raw)
    assert m["html"] == "<b>x</b>\n\n<div>y</div>" and m["text"].split() == ["x", "y"]
    assert parse_message(lines("Content-Type: text/html", "", "<b>x</b>"))["text"] is None


def test_forwarded_messages():
    raw = lines("Content-Type: message/rfc822", "", "From: a@b", "Subject: s", "", "inner")
    m = parse_message(raw)
    assert "Subject: s" in m["text"] and m["text"].endswith("inner\n") and m["attachments"] == []
    assert len(parse_message(raw, ParseOptions(force_rfc822_attachments=True))["attachments"]) == 1
    assert len(parse_message(raw, ParseOptions(rfc822_attachments=True))["attachments"]) == 1
    assert parse_message(raw, ParseOptions(max_rfc822_nesting_depth=0))["attachments"][0]["rfc822DepthExceeded"]


def test_limits():
    deep = b"".join(b"Content-Type: multipart/mixed; boundary=b%d\n\n--b%d\n" % (i, i) for i in range(260))
    with pytest.raises(MessageError):
        parse_message(deep)
    with pytest.raises(MessageError):
        parse_message(b"A: " + b"x" * 50, ParseOptions(max_headers_size=40))
    for bad in (True, -1, "5", 1.5):
        with pytest.raises(TypeError):
            ParseOptions(max_nesting_depth=bad)
    with pytest.raises(ValueError, match="Unknown"):
        ParseOptions(attachment_encoding="hex")


def test_flowed():
    assert unflow("a \nb\n-- \nc") == "a b\n-- \nc" and unflow("a \n b", True) == "ab"


def test_parts_have_parents():
    parts = parse_parts(lines("Content-Type: multipart/digest; boundary=A", "", "--A", "", "Subject: x", "", "--A", "Content-Type: text/csv", "", "1"))
    assert [(p["node_id"], p["parent_id"], p["mimeType"]) for p in parts] == [(0, None, "multipart/digest"), (1, 0, "message/rfc822"), (2, 0, "text/csv")]


def test_linear_time():
    start = time.time()
    parse_message(b"Content-Type: multipart/mixed; boundary=A\n\n" + b"--A\n\n\n" * 20_000)
    parse_message(b"Subject: x\n" + b" y\n" * 40_000 + b"\n")
    assert time.time() - start < 5


def test_spark_layer(spark, tmp_path):
    rows = spark.createDataFrame([(1, lines("From: A <a@b>", "To: g: c@d, e@f;", "", "hi")), (2, None), (3, b"A: " + b"x" * 100)], "id int, raw binary")
    p = M.parse_messages(rows, options=ParseOptions(max_headers_size=60)).cache()
    assert [(r.id, r._error is None) for r in p.orderBy("id").collect()] == [(1, True), (2, True), (3, False)]
    assert M.addresses_table(p, "id").count() == 3 and M.headers_table(p, "id").count() == 2
    assert p.where("id = 1").select(C.text_addresses("message.to")).first()[0] == "g:c@d, e@f;"
    with pytest.raises(Exception, match="exceeded"):
        M.parse_messages(rows, options=ParseOptions(max_headers_size=60), mode="FAILFAST").collect()
    assert M.parse_messages(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.parse_messages(rows.withColumn("message", F.lit(1)))


def test_files_and_stream(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"m{i}.eml").write_bytes(lines("From: a@b", "Date: Tue, 8 Mar 2005 23:40:36 +0200", f"Subject: s{i}", "", "x"))
    batch = M.parse_messages(eml.read_eml(spark, str(tmp_path))).select("message.subject")
    parsed = stream.parse_stream(eml.stream_eml(spark, str(tmp_path))).select("message.subject", "date_ts")
    q = stream.write_stream(parsed, str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(60)
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(r[0] for r in batch.collect()) == ["s0", "s1", "s2"]
    (tmp_path / "a.mbox").write_text("From x\nSubject: a\n\nb\n\nFrom y\nSubject: c\n\n>From d\n")
    boxes = M.parse_messages(eml.read_mbox(spark, str(tmp_path / "a.mbox")))
    assert sorted(r[0] for r in boxes.select("message.subject").collect()) == ["a", "c"]


def test_sql_functions(spark):
    C.register(spark)
    assert spark.sql("SELECT decode_words('=?utf-8?q?a_b?=')").first()[0] == "a b"
    found = spark.sql("SELECT r.role, r.address FROM VALUES (encode('To: a@b, c@d\n\n', 'UTF-8')) AS t(raw), LATERAL email_addresses(t.raw) r").collect()
    assert sorted(r[1] for r in found) == ["a@b", "c@d"]
