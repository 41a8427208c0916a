"""Calendar frequencies such as D, h, 15min, 2D, W, M, Q, Y: spans, bucket starts, calendars."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECONDS = {"S": 1, "T": 60, "MIN": 60, "H": 3600, "D": 86400}
_MONTHS = {"M": 1, "Q": 3, "Y": 12, "A": 12}


class Frequency:
    """n units; unit is seconds (fixed spans), W (weeks ending on Sunday) or months (labelled by their last day)."""

    def __init__(self, text: str) -> None:
        m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", text)
        unit = m[2].upper() if m else ""
        unit = {"ME": "M", "QE": "Q", "YE": "Y", "S": "S", "SEC": "S", "W-SUN": "W"}.get(unit, unit)
        if not m or unit not in {*_SECONDS, *_MONTHS, "W"}:
            raise ValueError(f"Unknown frequency: {text}")
        self.n, self.unit = int(m[1] or 1), unit
        self.seconds = self.n * _SECONDS[unit] if unit in _SECONDS else self.n * 7 * 86400 if unit == "W" else None
        self.months = self.n * _MONTHS[unit] if unit in _MONTHS else None

    def bucket(self, ts: Column, origin: Column) -> Column:
        """The label of a timestamp's bucket. origin: the first timestamp."""
        day = F.date_trunc("day", ts)
        if self.unit == "W" and self.n == 1:
            return F.date_trunc("week", ts) + F.expr("INTERVAL 6 DAYS")
        if self.months:
            first = F.date_trunc("month", origin)
            steps = F.floor(F.months_between(F.date_trunc("month", ts), first).cast("int") / self.months)
            if self.unit == "Q" and self.n == 1:
                return F.last_day(F.date_trunc("quarter", ts) + F.expr("INTERVAL 2 MONTHS")).cast("timestamp_ntz")
            if self.unit in "YA" and self.n == 1:
                return F.last_day(F.date_trunc("year", ts) + F.expr("INTERVAL 11 MONTHS")).cast("timestamp_ntz")
            if self.n == 1:
                return F.last_day(day).cast("timestamp_ntz")
            return F.last_day(F.add_months(first, (steps * self.months).cast("int"))).cast("timestamp_ntz")
        base = F.date_trunc("day", origin)
        apart = F.timestamp_diff("MICROSECOND", base, ts)
        whole = F.floor(apart / F.lit(float(self.seconds) * 1e6)) * F.lit(self.seconds)
        return F.timestamp_add("SECOND", whole.cast("long"), base)

    def months_between(self, low: Column, high: Column) -> Column:
        """The labels of whole months from low to high as an array, a handful for each year."""
        months = F.sequence(F.trunc(low, "month"), F.trunc(high, "month"), F.expr(f"INTERVAL {self.months} MONTHS"))
        return F.transform(months, lambda d: F.last_day(d).cast("timestamp_ntz"))
