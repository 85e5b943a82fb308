"""Durations: months and exact microseconds."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.lexer import AlgebraError

_ISO = re.compile(r"([+-])?P(?:([+-]?\d+)Y)?(?:([+-]?\d+)M)?(?:([+-]?\d+)W)?(?:([+-]?\d+)D)?(?:T(?:([+-]?\d+)H)?(?:([+-]?\d+)M)?(?:([+-]?\d+(?:\.\d+)?)S)?)?", re.I)
_UNITS = {"year": (12, 0), "month": (1, 0), "week": (0, 604_800), "day": (0, 86_400), "hour": (0, 3600), "minute": (0, 60), "second": (0, 1), "millisecond": (0, Decimal("0.001"))}
_SHORT = {"ms": Decimal("0.001"), "s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}


def parse(text: str) -> tuple[int, int]:
    """(months, microseconds) of ISO-8601 or SQL interval text."""
    s = text.strip()
    m = _ISO.fullmatch(s)
    if m and len(s.lstrip("+-")) > 1 and not s.upper().endswith("T"):
        sign = -1 if m[1] == "-" else 1
        y, mo, w, d, h, mi = (int(x or 0) for x in m.groups()[1:7])
        micros = (w * 604_800 + d * 86_400 + h * 3600 + mi * 60) * 1_000_000 + int(Decimal(m[8] or 0) * 1_000_000)
        return sign * (y * 12 + mo), sign * micros
    found = re.findall(r"([+-]?\s*\d+(?:\.\d+)?)\s*([a-zA-Z]+)", s)
    if not found or re.sub(r"([+-]?\s*\d+(?:\.\d+)?)\s*([a-zA-Z]+)", "", s).strip(" ,"):
        raise AlgebraError(f"{text!r} is no duration")
    months, micros = 0, Decimal(0)
    for n, unit in found:
        u = unit.lower().rstrip("s") or unit
        u = {"min": "minute", "sec": "second", "hr": "hour", "mon": "month", "yr": "year"}.get(u, u)
        if u not in _UNITS:
            raise AlgebraError(f"{unit!r} is no unit of time")
        value = Decimal(n.replace(" ", ""))
        months += int(value * _UNITS[u][0])
        micros += value * _UNITS[u][1] * 1_000_000
    return months, int(micros)


def literal(text: str) -> Column:
    months, micros = parse(text)
    if not months:
        return F.expr(f"make_dt_interval(0, 0, 0, cast({micros} as decimal(20,0)) / 1000000)") if abs(micros) >= 1 << 60 else F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(Decimal(micros) / 1_000_000).cast("decimal(18,6)"))
    if not micros:
        return F.make_ym_interval(F.lit(0), F.lit(months))
    return F.make_interval(F.lit(0), F.lit(months), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(Decimal(micros) / 1_000_000).cast("decimal(18,6)"))


def width(text: str) -> int:
    """Microseconds of a bucket width such as ``5m`` or ``PT5M``."""
    m = re.fullmatch(r"\s*(\d+)\s*(ms|s|m|h|d|w)\s*", text)
    if m:
        return int(Decimal(m[1]) * _SHORT[m[2]] * 1_000_000)
    months, micros = parse(text)
    if months or micros <= 0:
        raise AlgebraError(f"{text!r} is no width of a bucket")
    return micros
