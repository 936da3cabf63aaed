"""Date headers: RFC 5322 with its obsolete forms, and ISO 8601. Times without a zone are UTC."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from email.utils import parsedate_tz

_ISO = re.compile(r"([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2}))?)?(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]+))?)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?")


#: Dates as nearly all mail has them, and as iso_date writes them.
_PLAIN = re.compile(r"(?:[A-Z][a-z]{2}, )?([0-9]{1,2}) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) ([1-9][0-9]{3}) ([0-9]{2}):([0-9]{2}):([0-9]{2}) ([+-])([0-9]{2})([0-9]{2})")
_MONTHS = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}
_WRITTEN = re.compile(r"([1-9][0-9]{3})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})\.[0-9]{3}Z")


def _plain(text: str) -> datetime | None:
    m = _PLAIN.fullmatch(text)
    if not m:
        return None
    day, month, year, hour, minute, second, sign, hours, minutes = m.groups()
    whole = datetime(int(year), _MONTHS[month], int(day), int(hour), int(minute), int(second), tzinfo=timezone.utc)
    offset = 3600 * int(hours) + 60 * int(minutes)
    return whole - timedelta(seconds=-offset if sign == "-" else offset) if offset else whole


def _iso(text: str) -> datetime | None:
    m = _ISO.fullmatch(text)
    if not m:
        return None
    year, month, day, hour, minute, second, part, zone = m.groups()
    offset = timedelta()
    if zone and zone != "Z":
        offset = timedelta(hours=int(zone[1:3]), minutes=int(zone[-2:])) * (-1 if zone[0] == "-" else 1)
    whole = datetime(int(year), int(month or 1), int(day or 1), int(hour or 0), int(minute or 0), int(second or 0), int((part or "0")[:6].ljust(6, "0")), timezone.utc)
    return whole - offset


def _mail(text: str) -> datetime | None:
    got = parsedate_tz(re.sub(r"\([^()]*\)", " ", text))
    if not got:
        return None
    return datetime(*got[:6], tzinfo=timezone.utc) - timedelta(seconds=got[9] or 0)


def parse_date(text: str | None) -> datetime | None:
    try:
        return _plain(text or "") or _iso((text or "").strip()) or _mail(text or "")
    except (ValueError, OverflowError, TypeError):
        return None


def iso_date(text: str) -> str:
    """ISO 8601 with milliseconds and Z; the text itself if it is no date."""
    when = parse_date(text)
    if when and when.year > 999:
        return when.replace(tzinfo=None).isoformat(timespec="milliseconds") + "Z"
    return f"{when:%Y-%m-%dT%H:%M:%S}.{when.microsecond // 1000:03d}Z" if when else text


def shown_date(text: str) -> str:
    """As month/day/year, 24 hours, in UTC; the text itself if it is no date."""
    if m := _WRITTEN.fullmatch(text):
        year, month, day, hour, minute, second = map(int, m.groups())
        if 1 <= month <= 12 and 1 <= day <= 28 and hour < 24 and minute < 60 and second < 60:
            return f"{month}/{day}/{year}, {text[11:19]}"
    when = parse_date(text)
    return f"{when.month}/{when.day}/{when.year}, {when:%H:%M:%S}" if when else text
