"""Durations `<n>(h|d|w|M|y)` as Spark intervals; months and years clamp to the end of the month."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The units of the grammar.
UNITS = {"h": "HOUR", "d": "DAY", "w": "WEEK", "M": "MONTH", "y": "YEAR"}
_FORM = re.compile(r"([+-]?\d+)([a-zA-Z])")


class SpecError(ValueError):
    """A specification that cannot be answered as written."""


def parse(text: str, where: str = "duration") -> tuple[int, str]:
    m = _FORM.fullmatch(str(text))
    if m is None or m[2] not in UNITS:
        hint = "; minutes are not a unit, months are M" if m is not None and m[2] == "m" else ""
        raise SpecError(f"{where}: {text!r} is not a duration (<n> and one of {'/'.join(UNITS)}{hint})")
    return int(m[1]), UNITS[m[2]]


def shift(at: Column, text: str, sign: int = 1, where: str = "duration") -> Column:
    """The instant one duration after `at`, or before it where sign is -1."""
    n, unit = parse(text, where)
    return at + F.expr(f"INTERVAL '{sign * n}' {unit}" if unit != "WEEK" else f"INTERVAL '{7 * sign * n}' DAY")


def seconds(text: str, where: str = "duration") -> int:
    """Length in seconds; only fixed units have one."""
    n, unit = parse(text, where)
    if unit in ("MONTH", "YEAR"):
        raise SpecError(f"{where}: {text!r} has no fixed length (use h, d or w)")
    return n * {"HOUR": 3600, "DAY": 86400, "WEEK": 7 * 86400}[unit]


def instant(value: str, where: str) -> Column:
    """A timestamp literal in UTC, or an error that names the key."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z?)?", str(value)) is None:
        raise SpecError(f"{where} is not a date: {value!r} (use an ISO date like 2026-02-16)")
    return F.to_timestamp(F.lit(str(value).replace("T", " ").rstrip("Z")))
