"""Canonical values in a text: dates, amounts of money in mixed units, shares, fractions and periods, with offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

from .citations import compact

#: The patterns of each kind, units of money with what they stand for.
_NUMBER = r"(?:\d{1,3}(?:,\d{3}){1,5}|\d{1,18})(?:\.\d{1,4})?"
DATE = re.compile(r"((?:19|20)\d{2})\s*(?:년|[./-])\s*(\d{1,2})\s*(?:월|[./-])\s*(\d{1,2})\s*(?:일)?")
MONEY = re.compile(r"(?<![\d,])((?=\d)" + "".join(rf"(?:{_NUMBER}\s*{unit}\s*)?" for unit in "억천백십만") + rf"(?:{_NUMBER}\s*)?원)")
SHARE = re.compile(r"(?<![\d.])(\d{1,6}(?:\.\d{1,4})?)\s*(%|퍼센트|할)")
FRACTION = re.compile(r"(?<!\d)(\d{1,6})\s*분의\s*(\d{1,6})(?!\d)")
PERIOD = re.compile(r"(?<!\d)(\d{1,6})\s*(일|개월|년)")
LARGE, MYRIAD, SMALL = ("억", 10**8), ("만", 10**4), {"천": 1000, "백": 100, "십": 10}

VALUE = "kind string, start int, end int, raw string, canonical string"


def small_number(text: str) -> int | None:
    """Digits, or thousands, hundreds and tens in falling order with digits before and behind them; None for anything else."""
    if text.isdecimal():
        return int(text)
    total, rest = 0, text
    for unit, worth in SMALL.items():
        before, found, after = rest.partition(unit)
        if found:
            if before and not before.isdecimal():
                return None
            total, rest = total + int(before or 1) * worth, after
    if rest and not rest.isdecimal():
        return None
    return total + int(rest or 0)


def won(text: str) -> int | None:
    """An amount of money as a whole number of won; None if it is not one. Points and commas of numbers do not count."""
    value = compact(text)
    if not value.endswith("원"):
        return None
    value, total = value[:-1], 0
    before, found, after = value.partition(LARGE[0])
    if found:
        if before and not before.isdecimal():
            return None
        total, value = int(before or 1) * LARGE[1], after
    scale = 1
    if value.endswith(MYRIAD[0]):
        value, scale = value[:-1] or "1", MYRIAD[1]
    if not value:
        return total
    low = small_number(value)
    return None if low is None else total + low * scale


def _plain(number: Decimal) -> str:
    return format(number.normalize(), "f")


def values(text: str) -> Iterator[tuple]:
    """(kind, start, end, raw, canonical) of every value, by start; a period whose characters a date has is none."""
    found, dates = [], []
    for m in DATE.finditer(text):
        dates.append(m.span())
        found.append(("date", *m.span(), m[0], f"{int(m[1]):04d}-{int(m[2]):02d}-{int(m[3]):02d}"))
    for m in MONEY.finditer(text):
        if (amount := won(m[1])) is not None:
            found.append(("money", *m.span(), m[1], str(amount)))
    for m in SHARE.finditer(text):
        found.append(("percent", *m.span(), m[0], _plain(Decimal(m[1]) * (10 if m[2] == "할" else 1))))
    for m in FRACTION.finditer(text):
        found.append(("fraction", *m.span(), m[0], f"{int(m[2])}/{int(m[1])}"))
    at = 0
    for m in PERIOD.finditer(text):
        while at < len(dates) and dates[at][1] <= m.start():
            at += 1
        if at == len(dates) or dates[at][0] >= m.end():
            found.append(("period", *m.span(), m[0], f"{int(m[1])}{m[2]}"))
    yield from sorted(found, key=lambda v: v[1])
