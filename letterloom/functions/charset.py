"""Bytes to text by the labels that mail and the web use (WHATWG encoding labels)."""

from __future__ import annotations

import codecs
import re
from functools import lru_cache

# Labels of each encoding, and the codec that decodes it.
_LABELS = {
    "utf-8": "unicode-1-1-utf-8 unicode11utf8 unicode20utf8 utf-8 utf8 x-unicode20utf8",
    "cp1252": "ansi_x3.4-1968 ascii cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii",
    "iso8859-2": "csisolatin2 iso-ir-101 iso_8859-2:1987 l2 latin2",
    "iso8859-3": "csisolatin3 iso-ir-109 iso_8859-3:1988 l3 latin3",
    "iso8859-4": "csisolatin4 iso-ir-110 iso_8859-4:1988 l4 latin4",
    "iso8859-5": "csisolatincyrillic cyrillic iso-ir-144 iso_8859-5:1988",
    "iso8859-6": "arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6-e iso-8859-6-i iso-ir-127 iso_8859-6:1987",
    "iso8859-7": "csisolatingreek ecma-118 elot_928 greek greek8 iso-ir-126 iso_8859-7:1987 sun_eu_greek",
    "iso8859-8": "csiso88598e csiso88598i csisolatinhebrew hebrew iso-8859-8-e iso-8859-8-i iso-ir-138 iso_8859-8:1988 logical visual",
    "iso8859-10": "csisolatin6 iso-ir-157 l6 latin6",
    "iso8859-15": "csisolatin9 l9",
    "cp1254": "csisolatin5 iso-8859-9 iso-ir-148 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 l5 latin5",
    "cp874": "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620 windows-874",
    "cp866": "866 cp866 csibm866 ibm866",
    "koi8-r": "cskoi8r koi koi8 koi8-r koi8_r",
    "koi8-u": "koi8-ru koi8-u",
    "mac-roman": "csmacintosh mac macintosh x-mac-roman",
    "mac-cyrillic": "x-mac-cyrillic x-mac-ukrainian",
    "gb18030": "chinese csgb2312 csiso58gb231280 gb18030 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk",
    "big5hkscs": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "euc_jp": "cseucpkdfmtjapanese euc-jp x-euc-jp",
    "iso2022_jp": "csiso2022jp iso-2022-jp",
    "cp932": "csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis",
    "cp949": "cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949",
    "utf-16-le": "csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff utf-16 utf-16le",
    "utf-16-be": "unicodefffe utf-16be",
}
# Normalised labels that mail uses and the labels above lack.
_MAIL_ALIASES = {
    "iso88598i": "iso8859-8", "iso88598e": "iso8859-8",
    "shiftjis": "cp932", "windows31j": "cp932", "mskanji": "cp932",
    "eucjp": "euc_jp", "iso2022jp": "iso2022_jp", "iso2022jp1": "iso2022_jp", "iso2022jp2": "iso2022_jp", "junet": "iso2022_jp",
    "euckr": "cp949", "uhc": "cp949", "tis620": "cp874",
}
# Code pages by number.
_CODE_PAGES = {
    "932": "cp932", "936": "gb18030", "949": "cp949", "950": "big5hkscs", "874": "cp874",
    "51932": "euc_jp", "50220": "iso2022_jp", "50221": "iso2022_jp", "50222": "iso2022_jp",
}

# Characters of the web's koi8-u that the codec lacks.
_OTHERS = {"koi8-u": {0xAE: "\u045e", 0xBE: "\u040e"}}

_KNOWN = {label: codec for codec, labels in _LABELS.items() for label in labels.split()}
_LATIN = re.compile(r"iso[-_]?8859-?(2|3|4|5|6|7|8|10|13|14|15|16)")
_WINDOWS = re.compile(r"(?:windows-|cp|x-cp)(125[0-8])")
DEFAULT = "cp1252"
_MULTIBYTE = {"utf-8", "gb18030", "big5hkscs", "euc_jp", "iso2022_jp", "cp932", "cp949", "utf-16-le", "utf-16-be"}


def _standard(label: str) -> str | None:
    label = label.strip("\t\n\f\r ")
    if label in _KNOWN:
        return _KNOWN[label]
    if m := _LATIN.fullmatch(label):
        # 16 has no spelling without its hyphens
        return f"iso8859-{m[1]}" if m[1] != "16" or label == "iso-8859-16" else None
    return f"cp{m[1]}" if (m := _WINDOWS.fullmatch(label)) else None


@lru_cache(maxsize=1024)
def codec_of(label: str | None) -> str:
    """The codec for a label; windows-1252 for labels that mean nothing known."""
    label = (label or "utf8").strip().lower()
    bare = re.sub(r"[\s._-]+", "", re.sub(r"^(?:x-ms-|x-|cs)", "", label))
    page = re.fullmatch(r"(?:cp|windows|ms|ibm)([0-9]+)", bare)
    return _standard(label) or (page and _CODE_PAGES.get(page[1])) or _MAIL_ALIASES.get(bare) or _standard(bare) or DEFAULT


@lru_cache(maxsize=64)
def _single_bytes(codec: str) -> str:
    """256 characters; bytes without one are C1 controls below 0xA0 and replacement characters above."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b) if b < 0xA0 else "\ufffd")
    for b, c in _OTHERS.get(codec, {}).items():
        out[b] = c
    return "".join(out)


def decode_charset(data: bytes | None, label: str | None = None) -> str:
    """Decodes without ever failing; one leading byte order mark is dropped."""
    codec = codec_of(label)
    data = data or b""
    if codec in _MULTIBYTE:
        text = data.decode(codec, "replace")
        return text[1:] if codec.startswith("utf") and text.startswith("\ufeff") else text
    return codecs.charmap_decode(data, "replace", _single_bytes(codec))[0]
