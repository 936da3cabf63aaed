"""Encoded words of RFC 2047, parameters of RFC 2231 and structured header values."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

from .charset import decode_charset
from .jstext import NOT_WS, WS_CLASS, trim
from .memo import Memo
from .transfer import decode_base64_lenient

_WORD_TEXT = rf"=\?((?:(?!\?){NOT_WS})+)\?([QqBb])\?([^?]*)\?="
_WORD = re.compile(_WORD_TEXT)
_ONLY_WORDS = re.compile(rf"(?:{_WORD_TEXT}{WS_CLASS}*)+")
_BETWEEN = re.compile(r"[ \t\r\n]+")
_ESCAPED = re.compile(rb"=([0-9A-Fa-f]{2})")


@dataclass(frozen=True)
class EncodedWord:
    charset: str
    encoding: str
    text: str

    def joins(self, other: EncodedWord) -> bool:
        """Whether the bytes of both may belong to one run: a character may be cut between words."""
        if self.charset != other.charset or self.encoding != other.encoding:
            return False
        return self.encoding != "B" or (len(self.text) % 4 == 0 and not self.text.endswith("="))

    def decoded(self) -> str:
        return decode_word(self.charset, self.encoding, self.text)


def decode_word(charset: str, encoding: str, text: str) -> str:
    """One word; a language behind an asterisk in the charset is dropped."""
    kind = encoding.upper()
    if kind == "Q":
        text = re.sub(rf"={WS_CLASS}+(?=[0-9A-Fa-f])", "=", text)
        text = re.sub(rf"_|{WS_CLASS}", " ", text)
        data = _ESCAPED.sub(lambda m: bytes([int(m[1], 16)]), text.encode("utf-8", "replace"))
    elif kind == "B":
        data = decode_base64_lenient(re.sub(r"[^A-Za-z0-9+/=]+", "", text))
    else:
        data = text.encode("utf-8", "replace")
    return decode_charset(data, charset.split("*", 1)[0])


def is_encoded_words_only(text: str) -> bool:
    return _ONLY_WORDS.fullmatch(text) is not None


def _parts(text: str) -> Iterator[str | EncodedWord]:
    """Text and words in turn, without the white space that only separates two words."""
    at, after_word = 0, False
    for m in _WORD.finditer(text):
        gap = text[at : m.start()]
        if gap and not (after_word and _BETWEEN.fullmatch(gap)):
            yield gap
        yield EncodedWord(m[1], m[2].upper(), m[3])
        at, after_word = m.end(), True
    if at < len(text):
        yield text[at:]


def decode_words(text: str | None) -> str:
    """All encoded words of a text. Neighbours are first decoded as one where they may be one, and
    each alone if that leaves a replacement character."""
    if not text or "=?" not in text:
        return text or ""
    parts = list(_parts(text))
    if not any(isinstance(p, EncodedWord) for p in parts):
        return text
    merged: list[str | EncodedWord] = []
    for p in parts:
        last = merged[-1] if merged else None
        if isinstance(p, EncodedWord) and isinstance(last, EncodedWord) and last.joins(p):
            merged[-1] = replace(last, text=last.text + p.text)
        else:
            merged.append(p)
    shown = "".join(p if isinstance(p, str) else p.decoded() for p in merged)
    return shown if "\ufffd" not in shown else "".join(p if isinstance(p, str) else p.decoded() for p in parts)


def decode_percent(text: str, charset: str | None = None) -> str:
    """%HH as bytes, other characters as their UTF-8 bytes (a replacement for each half of a pair)."""
    out = bytearray()
    for piece in re.split(r"(%[0-9A-Fa-f]{2})", text):
        if len(piece) == 3 and piece[0] == "%" and re.fullmatch(r"%[0-9A-Fa-f]{2}", piece):
            out.append(int(piece[1:], 16))
        else:
            out += re.sub("[\U00010000-\U0010ffff]", "\ufffd\ufffd", piece).encode("utf-8", "replace")
    return decode_charset(bytes(out), charset or "utf-8")


def strip_comments(text: str) -> str:
    """Drops comments in parentheses. Quotes protect them, and inside a parameter's value only a
    parenthesis behind white space opens one. A comment without an end is dropped if no ; follows it, else nothing is."""
    if "(" not in text:
        return text
    kept: list[str] = []
    depth, opened, quoted, in_value = 0, -1, False, False
    scan = enumerate(text)
    for i, c in scan:
        if c == "\\":
            _, following = next(scan, (i, ""))
            if depth == 0:
                kept.append(c + following)
        elif depth == 0 and c == '"':
            quoted = not quoted
            kept.append(c)
        elif not quoted and c == "(" and (not in_value or not kept or kept[-1][-1:] in (" ", "\t")):
            opened = i if depth == 0 else opened
            depth += 1
        elif not quoted and c == ")" and depth:
            depth -= 1
        elif depth == 0:
            if not quoted and c in "=;":
                in_value = c == "="
            kept.append(c)
    return text if depth and ";" in text[opened:] else "".join(kept)


_NAME = re.compile(r"[^=;]*")
_VALUE = re.compile(r'"|;|[ \t]+|[^" \t;]+')
_QUOTED = re.compile(r'((?:\\.|[^"\\])*)("?)', re.S)


def _value(text: str, at: int) -> tuple[str, int]:
    """A value from ``at`` to the next ; outside quotes: white space around it is dropped, quoted
    parts are taken as they are, and what follows a closed quote is ignored up to the next quote."""
    out, space, closed = "", "", False
    while at < len(text):
        m = _VALUE.match(text, at)
        piece, at = m[0], m.end()
        if piece == ";":
            return out, at
        if piece == '"':
            q = _QUOTED.match(text, at)
            inner = re.sub(r"\\(.)", r"\1", q[1], flags=re.S)
            out += (space if out else "") + inner
            at, space = q.end(), ""
            if q[2]:
                closed = True
            else:
                # no end: all of the rest belongs to it
                at = len(text)
        elif piece[0] in " \t":
            space += piece
        elif not closed:
            out += (space if out else "") + piece
            space = ""
    return out, len(text) + 1


def parse_structured(text: str) -> tuple[str, dict[str, str]]:
    """A header's value (in lower case) and its parameters. The first of equal parameters counts, one
    without = is empty, and continued or percent-encoded ones (RFC 2231) are put together."""
    # the same few values stand in most messages
    value, params = _SHORT[text] if len(text) <= 256 else _structured(text)
    return value, params.copy()


def _structured(text: str) -> tuple[str, dict[str, str]]:
    text = strip_comments(text)
    value, at = _value(text, 0)
    params: dict[str, str] = {}
    while at <= len(text):
        m = _NAME.match(text, at)
        name, at = trim(m[0]).lower(), m.end()
        if at < len(text) and text[at] == "=":
            got, at = _value(text, at + 1)
            params.setdefault(name, got)
        else:
            if name:
                params.setdefault(name, "")
            at += 1
    return value.lower(), continued(params)


_SHORT = Memo(_structured)


_SECTION = re.compile(r"\*(?:([0-9]+)(\*)?)?$")


def continued(params: dict[str, str]) -> dict[str, str]:
    """Puts name*0, name*1*, ... together in order of their numbers; neighbouring encoded sections
    are decoded as one, sections whose name doesn't end in an asterisk are literal."""
    whole = {k: v for k, v in params.items() if not _SECTION.search(k)}
    found: dict[str, list[tuple[float, bool, str]]] = {}
    charset: dict[str, str | None] = {}
    for key, value in params.items():
        m = _SECTION.search(key)
        if not m:
            continue
        name, number, encoded = key[: m.start()].lower(), float(m[1] or 0), key.endswith("*")
        if number == 0 and encoded and (head := re.fullmatch(r"([^']*)'[^']*'([^\n\r\u2028\u2029]*)", value)):
            charset[name], value = head[1] or "utf-8", head[2]
        found.setdefault(name, []).append((number, encoded, value))
    for name, sections in found.items():
        out, run = "", ""
        for _, encoded, value in sorted(sections, key=lambda s: s[0]):
            if encoded:
                run += value
            else:
                out += (decode_percent(run, charset.get(name)) if run else "") + value
                run = ""
        whole[name] = out + (decode_percent(run, charset.get(name)) if run else "")
    return whole
