"""Content transfer encodings, on the lines of a body or on single values."""

from __future__ import annotations

import base64
import re
from collections.abc import Sequence

_HEX_ESCAPE = re.compile(rb"=([0-9A-Fa-f]{2})")
_NOT_BASE64 = re.compile(rb"[^A-Za-z0-9+/=]+")
_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Any byte outside the alphabet reads as the alphabet's first.
_LENIENT = bytes(b if b in _ALPHABET else 65 for b in range(256))


def _unit(data: bytes) -> bytes:
    """Unpadded base64; a last single character holds no byte."""
    if len(data) % 4 == 1:
        data = data[:-1]
    return base64.b64decode(data + b"=" * (-len(data) % 4))


def decode_base64_lenient(text: str | None) -> bytes:
    """Padding at the end is dropped; characters outside the alphabet count as A."""
    data = (text or "").encode("latin-1", "replace").rstrip(b"=")
    return _unit(data.translate(_LENIENT))


def base64_body(lines: Sequence[bytes]) -> bytes:
    """Every run of padding closes a unit of its own, so lines padded one by one decode too."""
    clean = _NOT_BASE64.sub(b"", b"".join(lines))
    return b"".join(map(_unit, re.split(b"=+", clean)))


def _unescape(m: re.Match[bytes]) -> bytes:
    return bytes([int(m[1], 16)])


def quoted_printable_body(lines: Sequence[bytes]) -> bytes:
    """Escapes become bytes, invalid ones stay; a line ending in = goes on in the next one."""
    out = []
    for line in lines:
        soft = line.endswith(b"=")
        line = line[:-1] if soft else line + b"\n"
        out.append(_HEX_ESCAPE.sub(_unescape, line) if b"=" in line else line)
    return b"".join(out)


def plain_body(lines: Sequence[bytes]) -> bytes:
    return b"".join([line + b"\n" for line in lines])


def split_lines(raw: bytes) -> list[bytes]:
    """Lines without their CR and LF bytes at the end; a last line may lack LF."""
    lines = raw.split(b"\n")
    if lines and not lines[-1]:
        lines.pop()
    return [line.rstrip(b"\r") for line in lines]


def decode_qp(text: str | bytes | None) -> bytes:
    """Quoted-printable value; line ends become LF, and none is added at the end."""
    raw = text.encode() if isinstance(text, str) else text or b""
    out = quoted_printable_body(split_lines(raw))
    return out[:-1] if out.endswith(b"\n") and not raw.endswith(b"\n") else out


def body(encoding: str, lines: Sequence[bytes]) -> bytes:
    if "base64" in encoding:
        return base64_body(lines)
    return quoted_printable_body(lines) if "quoted-printable" in encoding else plain_body(lines)
