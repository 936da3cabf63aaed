"""HTML to text and back, and entities."""

from __future__ import annotations

import re
from html.entities import html5

from .jstext import DOT, WS, WS_CLASS, trim

_ENTITY = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z]+[0-9]*);?")

# The steps from HTML to text, in their order (pattern, replacement, number, flags).
_A = re.ASCII
_I = re.ASCII | re.IGNORECASE
_STEPS = [
    (re.compile(p, f), r, n)
    for p, r, n, f in [
        (r"\r?\n", "\x01", 0, _A),
        (rf"<!--{DOT}*?-->", " ", 0, _I),
        (r"<br\b[^>]*>", "\n", 0, _I),
        (r"</?(p|div|table|tr|td|th)\b[^>]*>", "\n\n", 0, _I),
        (rf"<script\b[^>]*>{DOT}*?</script\b[^>]*>", " ", 0, _I),
        (rf"\A{DOT}*<body\b[^>]*>", "", 1, _I),
        (rf"\A{DOT}*</head\b[^>]*>", "", 1, _I),
        (rf"\A{DOT}*<!doctype\b[^>]*>", "", 1, _I),
        (rf"</body\b[^>]*>{DOT}*\Z", "", 1, _I),
        (rf"</html\b[^>]*>{DOT}*\Z", "", 1, _I),
        (rf"<a\b[^>]*href{WS_CLASS}*={WS_CLASS}*[\"']?([^\"'{re.escape(WS)}]+)[^>]*>", r" (\1) ", 0, _I),
        (r"</?(span|em|i|strong|b|u|a)\b[^>]*>", "", 0, _I),
        (rf"<li\b[^>]*>[\x01{re.escape(WS)}]*", "* ", 0, _I),
        (r"<hr\b[^>]*>", "\n-------------\n", 0, _A),
        (r"<[^>]*>", " ", 0, _A),
        (r"\x01", "\n", 0, _A),
        (r"[ \t]+", " ", 0, _A),
        (rf"^{WS_CLASS}+$", "", 0, _A | re.MULTILINE),
        (r"\n\n+", "\n\n", 0, _A),
        (r"\A\n+", "\n", 1, _A),
        (r"\n+\Z", "\n", 1, _A),
    ]
]


_CLOSINGS = {"<!--": "-->", "<scr": "</script"}
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _character(m: re.Match[str]) -> str:
    whole, name = m[0], m[1]
    if name[0] != "#":
        return html5.get(whole[1:], whole)
    if not whole.endswith(";"):
        return whole
    # a capital X makes no number, which reads as zero
    digits, base = (name[2:], 16) if name[1] == "x" else ("0" if name[1] == "X" else name[1:], 10)
    # no character has more digits
    code = int(digits, base) if len(digits := digits.lstrip("0") or "0") <= 8 else 0x110000
    return "\ufffd" if 0xD800 <= code <= 0xDFFF or code > 0x10FFFF else chr(code)


def decode_html_entities(text: str | None) -> str:
    """Named entities exactly as written, with or without ;, and numbers with one."""
    return _ENTITY.sub(_character, text or "")


#: The & first, as an escape holds one; no other of them is in an escape.
_ESCAPES = [(c, f"&#x{ord(c):02X};") for c in "&<>\"'?"]
_ESCAPED = re.compile("[&<>\"'?]")


def escape_html(text: str | None) -> str:
    out = trim(text or "")
    if not _ESCAPED.search(out):
        return out
    for character, escape in _ESCAPES:
        out = out.replace(character, escape)
    return out


def text_to_html(text: str | None) -> str:
    return "<div>" + escape_html(text).replace("\n", "<br />") + "</div>"


def html_to_text(html: str | None) -> str:
    text = html or ""
    for pattern, replacement, number in _STEPS:
        # behind the last end of a comment or script none of them is looked for, so that many open ones cost no more than one
        closing = _CLOSINGS.get(pattern.pattern[:4])
        cut = text.translate(_LOWER).rfind(closing) if closing else -1
        end = len(text) if not closing else 0 if cut < 0 else text.find(">", cut) + 1 or len(text)
        text = pattern.sub(replacement, text[:end], count=number) + text[end:]
    return decode_html_entities(text)
