"""The parts of a date that a grouping can name, and resampling steps."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnsupportedError

PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter,
    "dayofyear": F.dayofyear, "weekofyear": F.weekofyear, "week": F.weekofyear, "weekday": F.weekday, "dayofweek": F.weekday,
}
_FIXED = {"D": 86400, "h": 3600, "H": 3600, "min": 60, "T": 60, "s": 1, "S": 1}
_MONTHS = {"M": 1, "Q": 3, "Y": 12}
_WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


@dataclass(frozen=True)
class Rule:
    """What a resampling code means: n seconds or months; ends: bins end on a month's last day; weekday: that of a week's end."""

    n: int
    unit: str
    ends: bool = False
    weekday: int = 0

    @property
    def fixed(self) -> bool:
        return self.unit == "SECOND"

    @property
    def side(self) -> str:
        """The end of a bin that belongs to it and names it, unless said otherwise."""
        return "right" if self.ends or self.unit == "WEEK" else "left"


def part(label: Column, name: str) -> Column:
    if name == "season":
        return F.element_at(F.array(*map(F.lit, ("DJF", "MAM", "JJA", "SON"))), (F.floor((F.month(label) % 12) / 3) + 1).cast("int"))
    if name == "date":
        return F.to_date(label)
    if name not in PARTS:
        raise UnsupportedError(f"no date part is called {name!r}; there are {sorted([*PARTS, 'season', 'date'])}")
    return PARTS[name](label).cast("long")


def step(code: str) -> Rule:
    m = re.fullmatch(r"(\d*)([A-Za-z]+)(?:-([A-Z]{3}))?", code)
    n, unit, anchor = (int(m[1] or 1), m[2], m[3]) if m else (0, "", None)
    if unit in _FIXED and not anchor:
        return Rule(n * _FIXED[unit], "SECOND")
    if unit == "W" and (anchor or "SUN") in _WEEKDAYS:
        return Rule(n * 7 * 86400, "WEEK", weekday=_WEEKDAYS.index(anchor or "SUN"))
    calendar = re.fullmatch(r"([MQY])([SE]?)", unit)
    if calendar and not anchor:
        return Rule(n * _MONTHS[calendar[1]], "MONTH", calendar[2] != "S")
    raise UnsupportedError(f"can't resample by {code!r}")
