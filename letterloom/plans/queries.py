"""Queries over messages that are made from the test tables, and SQL on the tables themselves.

The tables hold no mail. Each query writes its columns into messages with built-in functions, reads
the messages with this library, and must give back what plain SQL says of the columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import messages as M
from .message import ParseOptions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _raw(*parts: Column | str) -> Column:
    """Bytes of a message; parts that are binary already stay."""
    return F.encode(_text(*parts), "UTF-8").alias("raw")


_MULTI = "MIME-Version: 1.0\r\nContent-Type: multipart/{}; boundary=\"AAA\"\r\n\r\n"


@query(
    """SELECT o_orderkey, 'order ' || o_orderkey AS subject, '<' || o_orderkey || '@orders.test>' AS message_id, 'Customer ' || o_custkey AS from_name,
        'c' || o_custkey || '@shop.test' AS from_address FROM orders"""
)
def headers_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    raw = _raw("From: Customer ", F.col("o_custkey"), " <c", F.col("o_custkey"), "@shop.test>\r\nSUBJECT:  order ", F.col("o_orderkey"), " \r\nMessage-ID: <", F.col("o_orderkey"), "@orders.test>\r\n\r\nbody")
    p = M.parse_headers(o.select("o_orderkey", raw), fields=["subject", "messageId", "from"])
    return p.select("o_orderkey", "message.subject", F.col("message.messageId").alias("message_id"), F.col("message.from.name").alias("from_name"), F.col("message.from.address").alias("from_address"))


@query("SELECT c_custkey, 'Account ' || c_name || chr(9) || 'end' AS subject, 3 AS n_lines, 'x-first' AS second_key FROM customer")
def headers_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    p = M.parse_headers(c.select("c_custkey", _raw("Subject: Account\r\n ", F.col("c_name"), "\r\n\tend\r\nX-First: a\r\nSubject: other\r\n\r\n")), fields=["headers", "headerLines"])
    return p.select("c_custkey", C.first_header("message.headers", "subject").alias("subject"), F.size("message.headerLines").alias("n_lines"), F.col("message.headers")[1]["key"].alias("second_key"))


@query("SELECT c_custkey, 1 AS field, 'Subject: Account ' || c_name || chr(9) || 'end' AS unfolded FROM customer UNION ALL SELECT c_custkey, 2, 'X-First: a' FROM customer")
def headers_unfolded_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    lines = c.select("c_custkey", F.posexplode(F.array(F.lit("Subject: Account"), _text(" ", F.col("c_name")), F.lit("\tend"), F.lit("X-First: a"))).alias("n", "line"))
    return M.unfold_headers(lines, "n", "line", "c_custkey").withColumn("field", F.col("field").cast("int"))


_BODY = "CASE WHEN text = '' THEN NULL WHEN suffix(text, chr(10)) THEN text ELSE text || chr(10) END"


@query(f"SELECT doc_id, {_BODY} AS body FROM documents")
def body_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return M.parse_messages(d.select("doc_id", _raw("Subject: x\r\n\r\n", F.col("text"))), fields=["text"]).select("doc_id", F.col("message.text").alias("body"))


@query(f"SELECT doc_id, {_BODY} AS body FROM documents")
def body_quoted_printable(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    soft = F.regexp_replace("text", r"([^\n]{60})(?=[^\n])", "$1\x01\r\n")
    qp = F.replace(F.replace(F.replace(soft, F.lit("="), F.lit("=3D")), F.lit("é"), F.lit("=C3=a9")), F.lit("\x01"), F.lit("="))
    raw = _raw("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: Quoted-Printable\r\n\r\n", qp)
    return M.parse_messages(d.select("doc_id", raw), fields=["text"]).select("doc_id", F.col("message.text").alias("body"))


@query("SELECT doc_id, nullif(text, '') AS body FROM documents")
def body_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    raw = _raw("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: (a comment) base64\r\n\r\n", F.base64(F.encode("text", "UTF-8")), "\r\n")
    return M.parse_messages(d.select("doc_id", raw), fields=["text"]).select("doc_id", F.col("message.text").alias("body"))


@query("SELECT doc_id, nullif(text, '') AS body FROM documents")
def body_base64_padded_lines_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of every document, each line of ten characters padded on its own."""
    d = _read(spark, sf_dir, "documents")
    lines = F.array_join(F.transform(_pieces("text", 10), lambda x: C.base64_text(F.encode(x, "UTF-8"))), "\r\n")
    raw = _raw("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n", lines, "\r\n")
    return M.parse_messages(d.select("doc_id", raw), fields=["text"]).select("doc_id", F.col("message.text").alias("body"))


def _pieces(c: Column | str, n: int) -> Column:
    """All of a text in pieces of n characters, the last one shorter."""
    return F.regexp_extract_all(c, F.lit(f"(?s).{{1,{n}}}"), F.lit(0))


def _q_word(c: Column) -> Column:
    q = c
    for a, b in (("=", "=3D"), ("_", "=5F"), ("?", "=3F"), (" ", "_")):
        q = F.replace(q, F.lit(a), F.lit(b))
    q = F.when(c.rlike(r"[^ -~]"), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "=$1")).otherwise(q)
    return _text("=?utf-8*en?q?", q, "?=")


@query("SELECT doc_id, text AS subject FROM documents")
def encoded_words_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, line breaks too, as runs of B and of Q words in turn; B words are cut between bytes."""
    d = _read(spark, sf_dir, "documents").select("doc_id", "text")
    b_words = lambda b: F.transform(F.sequence(F.lit(1), F.octet_length(b), F.lit(45)), lambda i: _text("=?UTF-8?B?", C.base64_text(F.substring(F.encode(b, "UTF-8"), i, F.lit(45))), "?="))
    q_words = lambda b: F.transform(_pieces(b, 10), _q_word)
    # words are decoded one by one where a replacement character shows, so then none may be cut within a character
    runs = F.transform(_pieces("text", 200), lambda b, i: F.array_join(F.when((i % 2 == 0) & ~F.contains("text", F.lit("\ufffd")), b_words(b)).otherwise(q_words(b)), "\t"))
    # one element: Spark doesn't find a Python function again whose argument holds nested lambdas, so that is a column of its own
    words = M.spread(d).select("doc_id", F.explode(F.array(F.array_join(runs, " "))).alias("words"))
    return words.select("doc_id", C.decode_words("words").alias("subject"))


@query(f"SELECT doc_id, {_BODY} AS body FROM documents")
def body_charset_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, in ISO-8859-1 where that holds its text (C1 controls are other characters in mail), else in UTF-8."""
    d = _read(spark, sf_dir, "documents")
    latin = ~F.col("text").rlike(r"[^\x{00}-\x{7F}\x{A0}-\x{FF}]")
    charset = F.when(latin, "iso-8859-1").otherwise("utf-8")
    body = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    raw = F.concat(F.encode(_text("Content-Type: text/plain; charset=\"", charset, "\"\r\n\r\n"), "UTF-8"), body).alias("raw")
    return M.parse_messages(d.select("doc_id", raw), fields=["text"]).select("doc_id", F.col("message.text").alias("body"))


@query("SELECT page_id, 'café-' || page_id || ' x.html' AS filename, 'text/html' AS mime FROM pages")
def attachment_continued_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages")
    raw = _raw("Content-Type: Text/HTML\r\nContent-Disposition: attachment;\r\n filename*1=\"", F.col("page_id"), " x.html\";\r\n filename*0*=utf-8''caf%C3%A9-\r\n\r\n", F.col("html"))
    return M.attachments_table(M.parse_messages(p.select("page_id", raw), fields=["attachments"]), "page_id").select("page_id", "filename", F.col("mimeType").alias("mime"))


@query("SELECT c_custkey, c_name || ', ' || c_mktsegment AS name, 'c' || c_custkey || '@shop.test' AS address FROM customer")
def addresses_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    a = C.parse_addresses(_text('"', F.col("c_name"), ", ", F.col("c_mktsegment"), '" <c', F.col("c_custkey"), "@shop.test>"))
    return c.select("c_custkey", a.alias("a")).select("c_custkey", F.col("a")[0]["name"].alias("name"), F.col("a")[0]["address"].alias("address"))


@query("SELECT n_name AS group_name, count(*) AS members, min('c' || c_custkey || '@shop.test') AS first_address FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def addresses_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "nation")
    # up to a thousand members a message
    named = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name", F.floor(F.col("c_custkey") / 1000))
    lists = named.agg(F.array_join(F.collect_list(_text("c", F.col("c_custkey"), "@shop.test")), ", ").alias("l"))
    p = M.parse_headers(lists.select(_raw("To: ", F.col("n_name"), ": ", F.col("l"), ";, last@shop.test\r\n\r\n")), fields=["to"])
    rows = M.addresses_table(p).where("group_name IS NOT NULL")
    return rows.groupBy("group_name").agg(F.count(F.lit(1)).alias("members"), F.min("address").alias("first_address"))


@query(r"SELECT doc_id, nullif(regexp_extract(text, '\b[^@\s]+@[^\s]+\b'), '') AS address FROM documents")
def addresses_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", C.call("find_address", "text").alias("address"))


@query("SELECT conv_id, string_agg(text || chr(10), chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def body_mixed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    parts = F.array_join(F.transform("t", lambda t: F.concat(F.lit("--AAA\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n"), t["text"], F.lit("\n"))), "")
    p = M.parse_messages(c.select("conv_id", _raw(_MULTI.format("mixed"), parts, "--AAA--\r\n")), fields=["text"])
    return p.select("conv_id", F.col("message.text").alias("body"))


@query("SELECT doc_id, text || chr(10) AS plain, CASE WHEN text IS NOT NULL THEN coalesce(html, 'none') || chr(10) END AS html FROM documents LEFT JOIN pages ON doc_id = page_id")
def body_alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, p = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pages")
    both = d.join(p, d.doc_id == p.page_id, "left").withColumn("html", F.coalesce("html", F.lit("none")))
    raw = _raw(_MULTI.format("alternative"), "--AAA\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n", F.col("text"), "\n--AAA\r\nContent-Type: text/html; charset=utf-8\r\n\r\n", F.col("html"), "\n--AAA--")
    return M.parse_messages(both.select("doc_id", raw), fields=["html", "text"]).select("doc_id", F.col("message.text").alias("plain"), F.col("message.html").alias("html"))


_ESCAPED = "replace(replace(replace(replace(replace(replace(trim(text || chr(10), ' ' || chr(9) || chr(10) || chr(13)), '&', '&#x26;'), '<', '&#x3C;'), '>', '&#x3E;'), '\"', '&#x22;'), '''', '&#x27;'), '?', '&#x3F;')"


@query(f"SELECT doc_id, coalesce(html, 'none') || chr(10) || chr(10) || '<div>' || replace({_ESCAPED}, chr(10), '<br />') || '</div>' AS html FROM documents LEFT JOIN pages ON doc_id = page_id")
def body_mixed_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, p = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pages")
    both = d.join(p, d.doc_id == p.page_id, "left").withColumn("html", F.coalesce("html", F.lit("none")))
    raw = _raw(_MULTI.format("mixed"), "--AAA\r\nContent-Type: text/html; charset=utf-8\r\n\r\n", F.col("html"), "\n--AAA\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n", F.col("text"), "\n--AAA--")
    return M.parse_messages(both.select("doc_id", raw), fields=["html"]).select("doc_id", F.col("message.html").alias("html"))


@query("SELECT page_id, octet_length(encode(html)) AS size, 'p' || page_id || '.html' AS filename, to_base64(encode(html)) AS content FROM pages")
def attachment_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages")
    raw = _raw(_MULTI.format("mixed"), "--AAA\r\n\r\nsee file\r\n--AAA\r\nContent-Type: text/html; name=\"p", F.col("page_id"), ".html\"\r\nContent-Disposition: Attachment\r\nContent-Transfer-Encoding: base64\r\n\r\n", F.base64(F.encode("html", "UTF-8")), "\r\n--AAA--\r\n")
    a = M.attachments_table(M.parse_messages(p.select("page_id", raw), fields=["attachments"]), "page_id")
    return a.select("page_id", "size", "filename", C.base64_text("content").alias("content"))


@query("SELECT page_id, to_base64(encode(html)) AS content, 'base64' AS encoding FROM pages")
def attachment_base64_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages")
    raw = _raw("Content-Type: application/octet-stream\r\nContent-Transfer-Encoding: base64\r\n\r\n", F.base64(F.encode("html", "UTF-8")))
    a = M.parse_messages(p.select("page_id", raw), options=ParseOptions(attachment_encoding="Base-64"), fields=["attachments"]).select("page_id", F.explode("message.attachments").alias("a"))
    return a.select("page_id", F.col("a.contentText").alias("content"), "a.encoding")


@query(
    """SELECT page_id, 0 AS image, 'i' || page_id AS cid, 'i' || page_id || '.png' AS filename, octet_length(encode(url)) AS size FROM pages
    UNION ALL SELECT page_id, 1, 'none', NULL, -1 FROM pages"""
)
def inline_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = _read(spark, sf_dir, "pages"), F.col("page_id")
    raw = _raw(_MULTI.format("related"), "--AAA\r\nContent-Type: text/html\r\n\r\n<img src=\"cid:i", i, "\"> <img alt=x src='cid:none'>\r\n--AAA\r\nContent-Type: image/png; name=i", i, ".png\r\nContent-ID: <i", i,
               ">\r\nContent-Transfer-Encoding: base64\r\n\r\n", F.base64(F.encode("url", "UTF-8")), "\r\n--AAA--\r\n")
    return M.inline_images(M.parse_messages(p.select("page_id", raw), fields=["html", "attachments"]), "page_id").select("page_id", "image", "cid", "filename", F.coalesce("size", F.lit(-1)).alias("size"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN TRUE END AS related, '<' || p_partkey || '@x>' AS content_id, upper(p_brand) AS description FROM part")
def attachment_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "related").otherwise("mixed")
    raw = _raw("Content-Type: multipart/", kind, "; boundary=AAA\r\n\r\n--AAA\r\nContent-Type: image/gif\r\nContent-ID: <", F.col("p_partkey"), "@x>\r\nContent-Description: =?us-ascii?Q?", F.replace(F.upper("p_brand"), F.lit("#"), F.lit("=23")), "?=\r\n\r\nGIF\r\n--AAA--")
    return M.attachments_table(M.parse_messages(p.select("p_partkey", raw), fields=["attachments"]), "p_partkey").select("p_partkey", "related", F.col("contentId").alias("content_id"), "description")


@query(
    """SELECT conv_id, CASE WHEN n > 4 THEN 1 ELSE 0 END AS attachments, CASE WHEN n > 4 THEN TRUE END AS too_deep FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)"""
)
def forwarded_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    p = M.parse_messages(c.select("conv_id", _raw(F.repeat(F.lit("Content-Type: message/rfc822\r\n\r\n"), F.col("n")), "Subject: leaf\r\n\r\nbody\r\n")), options=ParseOptions(max_rfc822_nesting_depth=4), fields=["attachments"])
    return p.select("conv_id", F.size("message.attachments").alias("attachments"), F.get("message.attachments", F.lit(0))["rfc822DepthExceeded"].alias("too_deep"))


@query(
    """SELECT o_orderkey, chr(10) || repeat('-', greatest(length('Subject: order ' || o_orderkey), length('From:    c' || o_custkey || '@shop.test'))) || chr(10) || 'From:    c' || o_custkey || '@shop.test' || chr(10)
        || 'Subject: order ' || o_orderkey || chr(10) || repeat('-', greatest(length('Subject: order ' || o_orderkey), length('From:    c' || o_custkey || '@shop.test'))) || chr(10) || chr(10) || 'inner' || chr(10) AS body FROM orders"""
)
def forwarded_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    raw = _raw("Content-Type: message/rfc822\r\n\r\nFrom: c", F.col("o_custkey"), "@shop.test\r\nSubject: order ", F.col("o_orderkey"), "\r\n\r\ninner\r\n")
    return M.parse_messages(o.select("o_orderkey", raw), fields=["text"]).select("o_orderkey", F.col("message.text").alias("body"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS attachments FROM orders")
def report_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "message/delivery-status").otherwise("text/csv")
    raw = _raw(_MULTI.format("report"), "--AAA\r\n\r\ntext\r\n--AAA\r\nContent-Type: ", kind, "\r\n\r\na: b\r\n--AAA\r\nContent-Type: message/rfc822\r\n\r\nSubject: x\r\n\r\ny\r\n--AAA--")
    return M.parse_messages(o.select("o_orderkey", raw), fields=["attachments"]).select("o_orderkey", F.size("message.attachments").alias("attachments"))


@query("SELECT conv_id, count(*) AS forwarded, 1 AS multiparts FROM conversations GROUP BY conv_id")
def digest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    t = M.parse_part_trees(c.select("conv_id", _raw(_MULTI.format("digest"), F.repeat(F.lit("--AAA\r\n\r\nSubject: x\r\n\r\ny\r\n"), F.col("n")), "--AAA--")))
    rows = M.parts_table(t, "conv_id")
    return rows.groupBy("conv_id").agg(F.count_if((F.col("mimeType") == "message/rfc822") & (F.col("parent_id") == 0)).alias("forwarded"), F.count("multipart").cast("int").alias("multiparts"))


@query("SELECT o_orderkey, strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.000Z') AS sent FROM orders")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.select("o_orderkey", C.parse_email_date(_text(F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss"), " +0200 (CEST)")).alias("sent"))


# The steps from HTML to text, in their order.
def _sql_html_to_text(column: str) -> str:
    out = column
    steps = [
        (r"\r?\n", "\x01", "g"), ("<!--.*?-->", " ", "gi"), (r"<br\b[^>]*>", "\n", "gi"), (r"</?(p|div|table|tr|td|th)\b[^>]*>", "\n\n", "gi"),
        (r"<script\b[^>]*>.*?</script\b[^>]*>", " ", "gi"), (r"^.*<body\b[^>]*>", "", "i"), (r"^.*</head\b[^>]*>", "", "i"), (r"^.*<!doctype\b[^>]*>", "", "i"),
        (r"</body\b[^>]*>.*$", "", "i"), (r"</html\b[^>]*>.*$", "", "i"), (r"<a\b[^>]*href\s*=\s*[\"']?([^\s\"']+)[^>]*>", r" (\1) ", "gi"),
        (r"</?(span|em|i|strong|b|u|a)\b[^>]*>", "", "gi"), (r"<li\b[^>]*>[\x01\s]*", "* ", "gi"), (r"<hr\b[^>]*>", "\n-------------\n", "g"), ("<[^>]*>", " ", "g"),
        (r"\x01", "\n", "g"), (r"[ \t]+", " ", "g"), (r"(?m)^\s+$", "", "g"), (r"\n\n+", "\n\n", "g"), (r"^\n+", "\n", ""), (r"\n+$", "\n", ""),
    ]
    for pattern, replacement, flags in steps:
        quoted = "'" + replacement.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\x01", "' || chr(1) || '") + "'"
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', {quoted}, '{flags}')"
    return _sql_entities(out)


def _sql_entities(column: str) -> str:
    out = column
    for name, character in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{character}')"
    return out


@query(f"SELECT page_id, {_sql_html_to_text('html')} AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.spread(_read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", C.html_to_text("html").alias("text"))


@query(f"SELECT page_id, {_sql_entities('html')} AS html FROM pages")
def html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.spread(_read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", C.decode_html_entities("html").alias("html"))


_TRIMMED = _ESCAPED.replace("text || chr(10)", "text")


@query(f"SELECT doc_id, {_TRIMMED} AS escaped, '<div>' || replace({_TRIMMED}, chr(10), '<br />') || '</div>' AS html FROM documents")
def text_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", C.escape_html("text").alias("escaped"), C.text_to_html("text").alias("html"))


@query(f"SELECT doc_id, {_BODY} AS body FROM documents")
def body_flowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; those that have a line which ends in a space, which flowed text cannot say, are sent as they are."""
    d = _read(spark, sf_dir, "documents")
    flowed = ~F.col("text").rlike(r" (\n|$)")
    # each space ends a line that goes on, and each line is stuffed with one
    soft = F.concat(F.lit(" "), F.replace(F.regexp_replace(F.replace("text", F.lit(" "), F.lit("  \r")), r"\n(?=(?s:.))", "\n "), F.lit("\r"), F.lit("\r\n ")))
    kind = F.when(flowed & (F.col("text") != ""), "; format=flowed; DelSp=yes").otherwise("")
    body = F.when(kind != "", soft).otherwise(F.col("text"))
    raw = _raw("Content-Type: text/plain; charset=utf-8", kind, "\r\n\r\n", body)
    return M.parse_messages(d.select("doc_id", raw), fields=["text"]).select("doc_id", F.col("message.text").alias("body"))


@query("SELECT doc_id, nullif(text, '') AS body FROM documents")
def body_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in UTF-16, as base64 in lines of 76 characters that cut its units."""
    d = _read(spark, sf_dir, "documents")
    lines = F.array_join(_pieces(C.base64_text(F.encode("text", "UTF-16LE")), 76), "\r\n")
    raw = _raw("Content-Type: text/plain; charset=UTF-16LE\r\nContent-Transfer-Encoding: base64\r\n\r\n", lines, "\r\n")
    return M.parse_messages(d.select("doc_id", raw), fields=["text"]).select("doc_id", F.col("message.text").alias("body"))


@query(f"SELECT page_id, 'before' || chr(10) || chr(10) || {_sql_html_to_text("html || chr(10)")} AS body FROM pages")
def body_html_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixed message whose second part is HTML only: its text is made from that."""
    p = _read(spark, sf_dir, "pages")
    raw = _raw(_MULTI.format("mixed"), "--AAA\r\n\r\nbefore\n--AAA\r\nContent-Type: text/html; charset=utf-8\r\n\r\n", F.col("html"), "\n--AAA--")
    return M.parse_messages(p.select("page_id", raw), fields=["text"]).select("page_id", F.col("message.text").alias("body"))


@query(
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'inline' WHEN 1 THEN 'attachment' END AS disposition, nullif(html, '') AS content, 'utf8' AS encoding FROM pages"""
)
def attachment_utf8_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as attachments shown as text, with each disposition and with none."""
    p = _read(spark, sf_dir, "pages")
    shown = F.when(F.col("page_id") % 3 == 0, "Content-Disposition: INLINE; filename=x\r\n").when(F.col("page_id") % 3 == 1, "Content-Disposition: attachment\r\n").otherwise("")
    raw = _raw("Content-Type: application/xhtml\r\nContent-Transfer-Encoding: base64\r\n", shown, "\r\n", F.base64(F.encode("html", "UTF-8")))
    a = M.parse_messages(p.select("page_id", raw), options=ParseOptions(attachment_encoding="utf-8"), fields=["attachments"]).select("page_id", F.explode("message.attachments").alias("a"))
    return a.select("page_id", "a.disposition", F.nullif("a.contentText", F.lit("")).alias("content"), "a.encoding")


@query("SELECT o_orderkey, 'box' || o_custkey || '@shop.test' AS delivered_to, CASE WHEN o_orderkey % 2 = 0 THEN 'bounce@shop.test' END AS return_path FROM orders")
def headers_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    back = F.when(F.col("o_orderkey") % 2 == 0, "<bounce@shop.test>").otherwise("<>")
    raw = _raw("Return-Path: ", back, "\r\nDelivered-To: box", F.col("o_custkey"), "@shop.test\r\nDelivered-To: second@shop.test\r\n\r\n")
    p = M.parse_headers(o.select("o_orderkey", raw), fields=["deliveredTo", "returnPath"])
    return p.select("o_orderkey", F.col("message.deliveredTo").alias("delivered_to"), F.col("message.returnPath").alias("return_path"))


# Markup and class names of headers of forwarded messages shown as HTML.
_ROW = "'<div class=\"postal-email-header-row\"><div class=\"postal-email-header-key\">{}</div><div class=\"postal-email-header-value{}>' || {} || '</div></div>'"
_LINK = "'<a href=\"mailto:' || {0} || '\" class=\"postal-email-address\">' || {1} || '</a>'"
_AND = "' <span class=\"postal-email-address-separator\">, </span> '"
_FORWARDED = " || chr(10) || ".join(
    [
        "'<div class=\"postal-email-header\">' || " + _ROW.format("From", '"', _LINK.format("'c' || o_custkey || '@shop.test'", "'R&#x26;D ' || o_custkey")),
        _ROW.format("Subject", ' postal-email-header-subject"', "'order &#x3C;' || o_orderkey || '&#x3E;'"),
        _ROW.format("Date", " postal-email-header-date\" data-date=\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') || '\"", "strftime(o_orderdate, '%-m/%-d/%Y, %H:%M:%S')"),
        _ROW.format("To", '"', " || ".join([_LINK.format("'a@shop.test'", "'&#x3C;a@shop.test&#x3E;'"), _AND, "'<span class=\"postal-email-address-group\">team:</span> '", _LINK.format("'b@shop.test'", "'B'"), "' <span class=\"postal-email-address-group\">;</span>'"])) + " || '</div>'",
    ]
)


@query(f"SELECT o_orderkey, {_FORWARDED} || chr(10) || '<p>' || o_orderkey || '</p>' || chr(10) AS html FROM orders")
def forwarded_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forwarded message as HTML: its headers with addresses, a group and a date, then its body."""
    o = _read(spark, sf_dir, "orders")
    raw = _raw("Content-Type: message/rfc822\r\n\r\nFrom: \"R&D ", F.col("o_custkey"), "\" <c", F.col("o_custkey"), "@shop.test>\r\nTo: a@shop.test, team: B <b@shop.test>;\r\nSubject: order <", F.col("o_orderkey"), ">\r\nDate: ",
               F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss"), " +0000\r\nContent-Type: text/html\r\n\r\n<p>", F.col("o_orderkey"), "</p>\r\n")
    return M.parse_messages(o.select("o_orderkey", raw), fields=["html"]).select("o_orderkey", F.col("message.html").alias("html"))


@query("SELECT c_custkey, repeat('word ', 15) || 'w' || c_custkey || ' ' || chr(13) || chr(10) || repeat('x', 90) || ' ' || chr(13) || chr(10) || 'end' AS folded FROM customer")
def folded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines longer than 80 characters, broken behind white space; a long word stays whole."""
    c = _read(spark, sf_dir, "customer")
    text = _text(F.repeat(F.lit("word "), F.lit(15)), "w", F.col("c_custkey"), " ", F.repeat(F.lit("x"), F.lit(90)), " end")
    return c.select("c_custkey", C.call("fold_lines", text, F.lit(80), F.lit(True)).alias("folded"))


@query("SELECT o_orderkey, 'order ' || o_orderkey AS subject, 'c' || o_custkey || '@shop.test' AS sender FROM orders")
def stream_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as a stream of messages that is read to its end: what a table of them gives."""
    from ..streaming.messages import parse_stream, shared_folder, write_stream

    schema = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").schema
    o = spark.readStream.schema(schema).option("pathGlobFilter", "*orders*").parquet(sf_dir)
    raw = _raw("From: c", F.col("o_custkey"), "@shop.test\r\nSubject: order ", F.col("o_orderkey"), "\r\n\r\nbody")
    out = shared_folder(spark, "stream-headers")
    parsed = parse_stream(o.select("o_orderkey", raw)).select("o_orderkey", "message.subject", F.col("message.from.address").alias("sender"))
    write_stream(parsed, f"{out}/messages", f"{out}/checkpoint", available_now=True).awaitTermination()
    return spark.read.parquet(f"{out}/messages")


@query("SELECT event_id, 'REQUEST' AS method, 'BEGIN:VCALENDAR' || chr(10) || 'SUMMARY:' || event_type || chr(10) || 'END:VCALENDAR' || chr(10) AS calendar FROM events")
def attachment_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    raw = _raw("Content-Type: text/calendar; method=request; charset=utf-8\r\n\r\nBEGIN:VCALENDAR\r\nSUMMARY:", F.col("event_type"), "\r\nEND:VCALENDAR\r\n\r\n\r\n")
    a = M.attachments_table(M.parse_messages(e.select("event_id", raw), fields=["attachments"]), "event_id")
    return a.select("event_id", "method", F.decode("content", "UTF-8").alias("calendar"))


@query("SELECT o_orderkey, CASE WHEN 9 + o_orderkey % 50 > 40 THEN 'Maximum header size of 40 bytes exceeded' END AS error FROM orders")
def limits_header_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    raw = _raw("Subject: ", F.repeat(F.lit("x"), (F.col("o_orderkey") % 50).cast("int")), "\r\n\r\nbody")
    return M.parse_messages(o.select("o_orderkey", raw), options=ParseOptions(max_headers_size=40), fields=["subject"]).select("o_orderkey", F.col("_error").alias("error"))


_THREAD = "SELECT conv_id, turn, role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations"


@query(f"SELECT role AS parent_role, reply_role, count(*) AS replies FROM (SELECT a.role AS reply_role, b.role FROM ({_THREAD}) a JOIN conversations b ON a.conv_id = b.conv_id AND a.before = b.turn) GROUP BY ALL")
def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies join what they answer by message id."""
    from pyspark.sql import Window

    c = _read(spark, sf_dir, "conversations").withColumn("before", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    mid = lambda t: F.concat(F.lit("<"), F.col("conv_id"), F.lit("."), t, F.lit("@talk.test>"))
    raw = _raw("From: ", F.col("role"), "@talk.test\r\nMessage-ID: ", mid(F.col("turn")), "\r\n", F.coalesce(F.concat(F.lit("In-Reply-To: "), mid(F.col("before")), F.lit("\r\n")), F.lit("")), "\r\n")
    p = M.parse_headers(c.select(raw), fields=["from", "messageId", "inReplyTo"]).select(F.split_part("message.from.address", F.lit("@"), F.lit(1)).alias("role"), "message.messageId", "message.inReplyTo")
    child = p.where("inReplyTo IS NOT NULL").select(F.col("role").alias("reply_role"), "inReplyTo")
    return child.join(p.select(F.col("role").alias("parent_role"), "messageId"), F.col("inReplyTo") == F.col("messageId")).groupBy("parent_role", "reply_role").agg(F.count(F.lit(1)).alias("replies"))


@query("SELECT key, count(*) AS headers FROM (SELECT unnest(['from', 'to', 'subject']) AS key FROM orders) GROUP BY key")
def header_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = M.parse_headers(_read(spark, sf_dir, "orders").select(_raw("From: a@b.test\r\nTO: c@d.test\r\nSubject: ", F.col("o_orderkey"), "\r\n\r\n")), fields=["headers"])
    return M.headers_table(p).groupBy("key").agg(F.count(F.lit(1)).alias("headers"))


@query("SELECT 'c' || o_custkey || '@shop.test' AS address, count(*) AS messages FROM orders GROUP BY o_custkey ORDER BY messages DESC, address LIMIT 20")
def top_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the twenty addresses that get most messages."""
    p = M.parse_headers(_read(spark, sf_dir, "orders").select(_raw("To: Customer <c", F.col("o_custkey"), "@shop.test>\r\nSubject: ", F.col("o_orderkey"), "\r\n\r\n")), fields=["to"])
    rows = M.addresses_table(p).where("role = 'to'").groupBy("address").agg(F.count(F.lit(1)).alias("messages"))
    return rows.orderBy(F.desc("messages"), "address").limit(20)
