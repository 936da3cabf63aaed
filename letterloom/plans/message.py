"""One message from bytes: its tree of parts, bodies, attachments and header fields.

A message is read in one pass over its lines. Parts keep references to their lines and decode them only when
their content is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from ..functions.addresses import parse_addresses
from ..functions.charset import decode_charset
from ..functions.dates import iso_date
from ..functions.html import html_to_text, text_to_html
from ..functions.jstext import trim
from ..functions.memo import Memo
from ..functions.render import FIELDS, html_header, text_header
from ..functions.transfer import body, split_lines
from ..functions.words import decode_words, parse_structured, strip_comments


class MessageError(ValueError):
    """A message that goes beyond a limit."""


def _limit(name: str, value: object, default: int) -> int:
    if value is None:
        return default
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value) or value < 0:
        raise TypeError(f"{name} must be a non-negative integer")
    return int(value)


ENCODINGS = ("arraybuffer", "base64", "utf8")


@dataclass(frozen=True)
class ParseOptions:
    """Limits and how forwarded messages and attachments are taken; checked when made."""

    rfc822_attachments: bool = False
    force_rfc822_attachments: bool = False
    attachment_encoding: str | None = None
    max_nesting_depth: int | None = None
    max_headers_size: int | None = None
    max_rfc822_nesting_depth: int | None = None

    def __post_init__(self) -> None:
        for name, default in (("max_nesting_depth", 256), ("max_headers_size", 2 * 1024 * 1024), ("max_rfc822_nesting_depth", 10)):
            object.__setattr__(self, name, _limit(name, getattr(self, name), default))
        encoding = re.sub(r"[-_\s]", "", str(self.attachment_encoding or "")).lower() or "arraybuffer"
        if encoding not in ENCODINGS:
            raise ValueError("Unknown attachment encoding")
        object.__setattr__(self, "attachment_encoding", encoding)


def _unfolded(lines: list[str]) -> list[list[str]]:
    """The lines of each header."""
    groups: list[list[str]] = []
    for line in lines:
        if groups and line[:1] in (" ", "\t"):
            groups[-1].append(line)
        else:
            groups.append([line])
    return groups


def written_headers(lines: list[str]) -> list[dict[str, str]]:
    """Headers as they were written, with their names."""
    raws = ["\n".join(g) for g in _unfolded(lines)]
    return [{"key": raw.partition(":")[0].strip(" \t").lower(), "line": raw} for raw in raws]


def named_headers(lines: list[str]) -> list[dict[str, str]]:
    """Headers, unfolded and named."""
    headers = []
    for g in _unfolded(lines):
        key, _, value = (g[0] if len(g) == 1 else "".join(g)).partition(":")
        key = key.strip(" \t")
        if "\r" in value:
            value = re.sub(r"\r+", " ", value)
        headers.append({"key": key.lower(), "originalKey": key, "value": value.strip(" \t")})
    return headers


def _transfer_encoding(value: str) -> str:
    token = re.search(r"[A-Za-z0-9_-]+", strip_comments(value).lower())
    return token[0] if token else ""


_ENCODINGS = Memo(_transfer_encoding, 64)


class Part:
    __slots__ = (
        "parent", "default_type", "ordinal", "depth", "state", "header_lines", "lines", "children", "headers", "type", "params", "disposition", "disposition_params", "encoding",
        "content_id", "description", "multipart", "boundary", "read", "_content",
    )

    def __init__(self, parent: Part | None = None, default_type: str = "text/plain", ordinal: int = 0) -> None:
        self.parent, self.default_type, self.ordinal = parent, default_type, ordinal
        self.depth: int = 0 if parent is None else parent.depth + 1
        self.state, self.read = "header", False
        self.header_lines: list[str] = []
        self.lines: list[bytes] = []
        self.children: list[Part] = []
        self.headers: list[dict[str, str]] = []
        self.params: dict[str, str] = {}
        self.disposition_params: dict[str, str] = {}
        self.type = self.disposition = self.encoding = self.content_id = self.description = ""
        self.multipart: str | None = None
        self.boundary: bytes | None = None
        self._content: bytes | None = None

    def read_headers(self) -> None:
        """Unfolds and names the header lines, and takes what decides how the body is read."""
        self.state, self.read = "body", True
        self.headers = named_headers(self.header_lines)
        first: dict[str, str] = {}
        for h in self.headers:
            first.setdefault(h["key"], h["value"])
        self.type, self.params = parse_structured(first.get("content-type", self.default_type))
        self.disposition, self.disposition_params = parse_structured(first.get("content-disposition", ""))
        encoding = first.get("content-transfer-encoding", "8bit")
        self.encoding = _ENCODINGS[encoding] if len(encoding) <= 64 else _transfer_encoding(encoding)
        self.content_id, self.description = first.get("content-id", ""), first.get("content-description", "")
        if self.type.startswith("multipart/"):
            self.multipart = self.type.partition("/")[2]
            self.boundary = self.params["boundary"].encode("utf-8", "replace") if self.params.get("boundary") else None

    @property
    def content(self) -> bytes | None:
        """Decoded body; none for a part whose headers were never read."""
        if self._content is None and self.read:
            self._content = body(self.encoding, self.lines)
        return self._content

    def text(self) -> str:
        text = decode_charset(self.content or b"", self.params.get("charset"))
        if self.params.get("format", "").lower() == "flowed":
            text = unflow(text, self.params.get("delsp", "").lower() == "yes")
        return text

    def walk(self) -> Iterator[Part]:
        todo = [self]
        while todo:
            part = todo.pop()
            yield part
            todo += reversed(part.children)


def unflow(text: str, delete_space: bool = False) -> str:
    """Text of format=flowed: lines that end in a space go on, but for the signature's separator."""
    out: list[str] = []
    for line in re.split(r"\r?\n", text):
        line = line.removeprefix(" ")
        if out and out[-1].endswith(" ") and out[-1] != "-- ":
            out[-1] = (out[-1][:-1] if delete_space else out[-1]) + line
        else:
            out.append(line)
    return "\n".join(out)


def read_tree(raw: bytes, options: ParseOptions) -> Part:
    """The tree of parts. Of the open multiparts whose boundary a line shows, the one opened last counts."""
    root = current = Part()
    open_: list[Part] = []
    header_bytes = 0

    def headers_end(part: Part) -> None:
        part.read_headers()
        if part.boundary:
            open_.append(part)

    def close(part: Part) -> None:
        """A part and all that is open in it, the part itself first."""
        todo = [part]
        while todo:
            p = todo.pop()
            if p.state == "finished":
                continue
            if p.state == "header":
                headers_end(p)
            if p in open_:
                open_.remove(p)
            p.state = "finished"
            todo += reversed(p.children)

    lines = split_lines(raw)
    for i, line in enumerate(lines, 1):
        if len(line) > 2 and line[:2] == b"--" and open_:
            owner, last = _shown(line, open_)
            if owner is not None:
                if last:
                    close(owner)
                    current = owner.parent or root
                else:
                    # the others were closed when this one began
                    if owner.children:
                        close(owner.children[-1])
                    current = Part(owner, "message/rfc822" if owner.multipart == "digest" else "text/plain", len(owner.children))
                    if current.depth > options.max_nesting_depth:
                        raise MessageError(f"Maximum MIME nesting depth of {options.max_nesting_depth} levels exceeded")
                    owner.children.append(current)
                continue
        if current.state == "header":
            if not line:
                headers_end(current)
                if not open_:
                    # nothing can end this part
                    current.lines = lines[i:]
                    break
                continue
            header_bytes += len(line)
            if header_bytes > options.max_headers_size:
                raise MessageError(f"Maximum header size of {options.max_headers_size} bytes exceeded")
            current.header_lines.append(line.decode("utf-8", "replace"))
        elif current.state == "body":
            current.lines.append(line)
    if raw:
        close(root)
    return root


def _shown(line: bytes, open_: list[Part]) -> tuple[Part | None, bool]:
    """The multipart whose boundary the line shows, and whether it is the last one."""
    for part in reversed(open_):
        if line.startswith(part.boundary, 2):
            rest = line[2 + len(part.boundary) :]
            last = rest.startswith(b"--")
            if not (rest[2:] if last else rest).strip(b" \t"):
                return part, last
    return None, False


Entry = tuple[str, object]


class _Bodies:
    """Text of each kind in document order, by the alternative (or part) that it belongs to."""

    def __init__(self) -> None:
        self.by: dict[int, dict[str, list[Entry]]] = {}
        self.kinds: set[str] = set()
        self.keep: list[object] = []

    def add(self, owner: Part, kind: str, entry: Entry) -> None:
        self.keep.append(owner)
        self.by.setdefault(id(owner), {}).setdefault(kind, []).append(entry)
        self.kinds.add(kind)

    def shown(self, kind: str) -> Iterator[tuple[str, object, bool]]:
        """The entries that make the text of a kind, and whether they are of that kind: the other one stands where there is only that."""
        other = "html" if kind == "plain" else "plain"
        for entries in self.by.values() if kind in self.kinds else ():
            own = kind in entries
            for what, value in entries.get(kind if own else other, ()):
                yield what, value, own

    def joined(self, kind: str) -> str | None:
        """All text of a kind, made from the other kind where there is only that."""
        make, header = (html_to_text, text_header) if kind == "plain" else (text_to_html, html_header)
        return "\n".join([header(value) if what == "message" else value if own else make(value) for what, value, own in self.shown(kind)]) or None

    def has(self, kind: str) -> bool:
        """Whether joined() gives a text; a header is never empty, nor are two entries, as a line end joins them."""
        make = html_to_text if kind == "plain" else text_to_html
        return kind in self.kinds and any(i or what == "message" or (value if own else make(value)) for i, (what, value, own) in enumerate(self.shown(kind)))


def _attachment(part: Part, related: bool, too_deep: bool) -> dict[str, object]:
    name = part.disposition_params.get("filename") or part.params.get("name")
    out: dict[str, object] = dict.fromkeys(ATTACHMENT_FIELDS)
    out |= {"filename": decode_words(name) if name else None, "mimeType": part.type, "disposition": part.disposition or None, "content": part.content}
    if related and part.content_id and not too_deep:
        out["related"] = True
    if too_deep:
        out["rfc822DepthExceeded"] = True
    if part.description:
        out["description"] = decode_words(part.description)
    if part.content_id:
        out["contentId"] = part.content_id
    if part.type in ("text/calendar", "application/ics"):
        if part.params.get("method"):
            out["method"] = trim(part.params["method"].upper())
        out["content"] = (part.text().replace("\r\n", "\n").rstrip("\n") + "\n").encode("utf-8", "replace")
    return out


ATTACHMENT_FIELDS = ("filename", "mimeType", "disposition", "related", "description", "contentId", "method", "rfc822DepthExceeded", "content", "contentText", "encoding")
REPORTS = ("message/delivery-status", "message/feedback-report")


#: Options of forwarded messages: the limits alone.
_LIMITS = Memo(lambda o: ParseOptions(max_nesting_depth=o.max_nesting_depth, max_headers_size=o.max_headers_size, max_rfc822_nesting_depth=o.max_rfc822_nesting_depth), 64)


def _collect(root: Part, options: ParseOptions, depth: int, texts: bool = True, files: bool = True) -> tuple[_Bodies, list[dict[str, object]]]:
    """Bodies and attachments; without ``texts`` or ``files`` none of these are made, but limits hold all the same."""
    bodies, attachments = _Bodies(), []
    forced = options.force_rfc822_attachments or any([p.multipart is None and p.type in REPORTS for p in (root.walk() if root.children else (root,))])
    todo: list[tuple[Part, Part | None, bool]] = [(root, None, False)]
    while todo:
        part, alternative, related = todo.pop()
        if part.multipart is not None:
            alternative = part if part.multipart == "alternative" else alternative
            related = related or part.multipart == "related"
        else:
            inline = part.type == "message/rfc822" and (part.disposition or ("attachment" if options.rfc822_attachments else "inline")) == "inline" and not forced
            too_deep = inline and depth >= options.max_rfc822_nesting_depth
            if inline and not too_deep:
                limits = _LIMITS[options]
                forwarded = read_tree(part.content or b"", limits)
                inner, inner_files = _collect(forwarded, limits, depth + 1, texts, files)
                attachments += inner_files
                if texts:
                    message, html = header_fields(forwarded.headers, _SHOWN), inner.has("html")
                    if not html or inner.has("plain"):
                        bodies.add(part, "plain", ("message", message))
                    if html:
                        bodies.add(part, "html", ("message", message))
                    bodies.by |= inner.by
                    bodies.keep += [inner]
            elif part.type in ("text/plain", "text/html") and part.disposition != "attachment":
                if texts:
                    bodies.add(alternative or part, part.type[5:], ("text", part.text()))
            elif files and part.content is not None:
                attachments.append(_attachment(part, related, too_deep))
        if part.children:
            todo += [(c, alternative, related) for c in reversed(part.children)]
    return bodies, attachments


SINGLE = {"from": "from", "sender": "sender"}
PLAIN_ADDRESS = {"delivered-to": "deliveredTo", "return-path": "returnPath"}
LISTS = {"to": "to", "cc": "cc", "bcc": "bcc", "reply-to": "replyTo"}
TEXTS = {"subject": "subject", "message-id": "messageId", "in-reply-to": "inReplyTo", "references": "references"}


#: Names of the fields by the header that they come from.
FIELD_KEYS = {name: key for group in (SINGLE, PLAIN_ADDRESS, LISTS, TEXTS, {"date": "date"}) for key, name in group.items()}
_KINDS = {name: kind for kind, group in (("text", TEXTS), ("list", LISTS), ("single", SINGLE)) for name in group.values()} | {"date": "date"}
#: Those that the header of a forwarded message shows.
_SHOWN = tuple(name for _, name in FIELDS)


def _field(name: str, values: list[str]) -> object:
    """A field from the values of its headers, in their order."""
    if not values:
        return None
    first, kind = values[0], _KINDS.get(name)
    if kind == "text":
        return decode_words(first) if first else None
    if kind == "list":
        return [a for v in values if v for a in parse_addresses(v)] or None
    if kind == "date":
        return iso_date(first)
    found = parse_addresses(first) if first else []
    if kind == "single":
        return found[0] if found else None
    return (found[0]["address"] or None) if found else None


def header_fields(headers: list[dict[str, str]], names: Iterable[str] = tuple(FIELD_KEYS)) -> dict[str, object]:
    """The named fields, which come from headers alone. The first of equal headers counts, even if it is
    empty; of the lists all count, in their order."""
    values: dict[str, list[str]] = {}
    for h in headers:
        values.setdefault(h["key"], []).append(h["value"])
    return {name: _field(name, values.get(FIELD_KEYS[name], ())) for name in names}


def _headers(headers: list[dict[str, str]], lines: list[str], names: Iterable[str]) -> dict[str, object]:
    """Those of HEADER_FIELDS that are named."""
    out: dict[str, object] = {"headers": headers} if "headers" in names else {}
    if "headerLines" in names:
        out["headerLines"] = written_headers(lines)
    return out | header_fields(headers, [n for n in names if n in FIELD_KEYS])


def as_bytes(raw: bytes | str | None) -> bytes:
    return raw.encode("utf-8", "replace") if isinstance(raw, str) else bytes(raw or b"")


HEADER_FIELDS = ("headers", "headerLines", *FIELD_KEYS)
MESSAGE_FIELDS = (*HEADER_FIELDS, "html", "text", "attachments")
_DEFAULTS = ParseOptions()


def parse_message(raw: bytes | str | None, options: ParseOptions | None = None, names: Iterable[str] = MESSAGE_FIELDS) -> dict[str, object]:
    """The named ones of MESSAGE_FIELDS; others are not made. The whole message is read, so its limits hold for all names."""
    options = options or _DEFAULTS
    root = read_tree(as_bytes(raw), options)
    bodies, attachments = _collect(root, options, 0, "html" in names or "text" in names, "attachments" in names)
    message = _headers(root.headers, root.header_lines, names)
    message |= {name: bodies.joined(kind) for name, kind in (("html", "html"), ("text", "plain")) if name in names}
    if "attachments" in names:
        message["attachments"] = attachments
    for a in attachments:
        if a["content"] is not None and options.attachment_encoding == "base64":
            import base64

            a |= {"contentText": base64.b64encode(a["content"]).decode(), "encoding": "base64", "content": None}
        elif a["content"] is not None and options.attachment_encoding == "utf8":
            a |= {"contentText": decode_charset(a["content"], "utf-8"), "encoding": "utf8", "content": None}
    return message


_END = re.compile(rb"(?:\A|\n)\r*\n")


def parse_header_block(raw: bytes | str | None, options: ParseOptions | None = None, names: Iterable[str] = HEADER_FIELDS) -> dict[str, object]:
    """The named ones of HEADER_FIELDS; reads no further than the first empty line."""
    raw, most = as_bytes(raw), (options or _DEFAULTS).max_headers_size
    end = _END.search(raw)
    lines = [x for x in split_lines(raw[: end.start()] if end else raw) if x]
    if sum(map(len, lines)) > most:
        raise MessageError(f"Maximum header size of {most} bytes exceeded")
    texts = [x.decode("utf-8", "replace") for x in lines]
    return _headers(named_headers(texts), texts, names)


def parse_parts(raw: bytes | str | None, options: ParseOptions | None = None) -> list[dict[str, object]]:
    """The tree as a list: parts in document order with their number, their parent's and their depth."""
    root = read_tree(as_bytes(raw), options or ParseOptions())
    parts = list(root.walk())
    number = {id(p): i for i, p in enumerate(parts)}
    out = []
    for p in parts:
        chain, up = [], p.parent
        while up is not None:
            chain.append(up.multipart)
            up = up.parent
        out.append(
            {
                "node_id": number[id(p)], "parent_id": number[id(p.parent)] if p.parent else None, "depth": p.depth, "ordinal": p.ordinal,
                "mimeType": p.type, "params": p.params, "disposition": p.disposition or None, "encoding": p.encoding, "contentId": p.content_id or None, "multipart": p.multipart,
                "in_alternative": "alternative" in chain, "in_related": "related" in chain, "content": None if p.multipart is not None else p.content,
            }
        )
    return out
