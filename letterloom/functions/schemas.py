"""Types of messages and of what is in them."""

from __future__ import annotations

from pyspark.sql import types as T


def _ddl(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


MAILBOX = "STRUCT<name: STRING, address: STRING>"
ADDRESS = f"STRUCT<name: STRING, address: STRING, `group`: ARRAY<{MAILBOX}>>"
ADDRESSES = f"ARRAY<{ADDRESS}>"
HEADERS = "ARRAY<STRUCT<key: STRING, originalKey: STRING, value: STRING>>"
HEADER_LINES = "ARRAY<STRUCT<key: STRING, line: STRING>>"
ATTACHMENTS = (
    "ARRAY<STRUCT<filename: STRING, mimeType: STRING, disposition: STRING, related: BOOLEAN, description: STRING, contentId: STRING, method: STRING, "
    "rfc822DepthExceeded: BOOLEAN, content: BINARY, contentText: STRING, encoding: STRING>>"
)
HEADER_FIELDS = (
    f"headers {HEADERS}, headerLines {HEADER_LINES}, `from` {ADDRESS}, sender {ADDRESS}, replyTo {ADDRESSES}, deliveredTo STRING, returnPath STRING, "
    f"`to` {ADDRESSES}, cc {ADDRESSES}, bcc {ADDRESSES}, subject STRING, messageId STRING, inReplyTo STRING, `references` STRING, `date` STRING"
)
MESSAGE = f"{HEADER_FIELDS}, html STRING, text STRING, attachments {ATTACHMENTS}"
PARTS = (
    "ARRAY<STRUCT<node_id: INT, parent_id: INT, depth: INT, ordinal: INT, mimeType: STRING, params: MAP<STRING, STRING>, disposition: STRING, encoding: STRING, "
    "contentId: STRING, multipart: STRING, in_alternative: BOOLEAN, in_related: BOOLEAN, content: BINARY>>"
)
STRUCTURED = "STRUCT<value: STRING, params: MAP<STRING, STRING>>"
