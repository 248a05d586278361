"""Date functions over text: text in, text out, in UTC; what can't be parsed gives null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FULL = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,3})?)?)?$"
_CLOCK = r"^\d{2}:\d{2}(:\d{2})?$"
_NUMBER = r"^[+-]?\d+(\.\d+)?$"
#: Directives of strftime and the patterns they are written with.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}
_UNITS = ("second", "minute", "hour", "day", "month", "year")


def parse(text: Column | str, unixepoch: bool = False) -> Column:
    """Timestamp of a time string: now, a date with or without time, a time alone (on 2000-01-01), a Julian day or, with unixepoch, seconds."""
    s = F.trim(F.col(text) if isinstance(text, str) else text)
    number = s.try_cast("double")
    days = number if unixepoch else (number - 2440587.5) * 86400.0
    full = F.when(s.rlike(_FULL), s.try_cast("timestamp"))
    clock = F.when(s.rlike(_CLOCK), F.concat(F.lit("2000-01-01 "), s).try_cast("timestamp"))
    return F.when(F.lower(s) == "now", F.current_timestamp()).when(s.rlike(_NUMBER), F.timestamp_millis(F.round(days * 1000).cast("long"))).otherwise(F.coalesce(full, clock))


def modified(ts: Column, *modifiers: str) -> Column:
    """ts after the modifiers in order: start of day, month or year, +-N units, utc. An unknown one is an error."""
    for m in modifiers:
        x = m.strip().lower()
        if x in ("utc", "unixepoch"):
            continue
        if x.startswith("start of "):
            ts = F.date_trunc(x.removeprefix("start of "), ts)
            continue
        found = re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s*([a-z]+?)s?", x)
        if not found or found[2] not in _UNITS:
            raise ValueError(f"unknown modifier: {m}")
        n, unit = float(found[1]), found[2]
        if unit in ("month", "year"):
            months = int(n) * (12 if unit == "year" else 1)
            ts = ts + F.make_interval(months=F.lit(months))
        else:
            ts = ts + F.make_dt_interval(secs=F.lit(n * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]))
    return ts


def _ts(text: Column | str, modifiers: tuple[str, ...]) -> Column:
    return modified(parse(text, "unixepoch" in (m.strip().lower() for m in modifiers)), *modifiers)


def date(text: Column | str, *modifiers: str) -> Column:
    return F.date_format(_ts(text, modifiers), "yyyy-MM-dd")


def time(text: Column | str, *modifiers: str) -> Column:
    return F.date_format(_ts(text, modifiers), "HH:mm:ss")


def datetime(text: Column | str, *modifiers: str) -> Column:
    return F.date_format(_ts(text, modifiers), "yyyy-MM-dd HH:mm:ss")


def unixepoch(text: Column | str, *modifiers: str) -> Column:
    return F.floor(F.unix_millis(_ts(text, modifiers)) / 1000).cast("long")


def julianday(text: Column | str, *modifiers: str) -> Column:
    return F.unix_millis(_ts(text, modifiers)) / 86400000.0 + 2440587.5


def strftime(form: str, text: Column | str, *modifiers: str) -> Column:
    """The directives %Y %m %d %H %M %S %f %w %W %j %s %%; other characters stand for themselves."""
    ts = _ts(text, modifiers)
    parts = []
    for piece in re.findall(r"%.|[^%]+", form):
        if piece in DIRECTIVES:
            parts.append(F.date_format(ts, DIRECTIVES[piece]))
        elif piece == "%f":
            parts.append(F.date_format(ts, "ss.SSS"))
        elif piece == "%w":
            parts.append((F.dayofweek(ts) - 1).cast("string"))
        elif piece == "%j":
            parts.append(F.lpad(F.dayofyear(ts).cast("string"), 3, "0"))
        elif piece == "%W":  # weeks from the first Monday
            monday = F.pmod(F.dayofweek(ts) - 2, F.lit(7))
            parts.append(F.lpad(F.floor((F.dayofyear(ts) - 1 - monday + 7) / 7).cast("string"), 2, "0"))
        elif piece == "%s":
            parts.append(F.floor(F.unix_millis(ts) / 1000).cast("string"))
        elif piece == "%%":
            parts.append(F.lit("%"))
        elif piece.startswith("%"):
            raise ValueError(f"unknown directive: {piece}")
        else:
            parts.append(F.when(ts.isNotNull(), F.lit(piece)))
    return F.concat(*parts)
