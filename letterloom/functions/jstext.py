"""White space as mail text rules mean it: Unicode spaces and the byte order mark, no C0 separators."""

from __future__ import annotations

import re

WS = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS_CLASS = "[" + re.escape(WS) + "]"
NOT_WS = "[^" + re.escape(WS) + "]"
#: Any character but a line end.
DOT = "[^\n\r\u2028\u2029]"
REPLACEMENT = "\ufffd"


def trim(text: str) -> str:
    return text.strip(WS)
