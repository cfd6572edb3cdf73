"""Dates, times and intervals.

Intervals are texts such as ``1mo2d-3h``. A naive datetime is TIMESTAMP_NTZ, an instant is
TIMESTAMP; a time of day and exact nanoseconds are long. ``kind`` names a column's type: naive
datetimes never pass the session's zone, instants have calendar days and months in it.
Everything is built in but the business-day arithmetic, which is closed-form over weeks plus
a bounded list of holidays.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = re.compile(r"(-?\d+)(ns|us|ms|mo|s|m|h|d|w|q|y)")
_MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 7 * 86_400_000_000}
_MONTHS = {"mo": 1, "q": 3, "y": 12}


@dataclass(frozen=True)
class Interval:
    months: int
    micros: int

    def __neg__(self) -> Interval:
        return Interval(-self.months, -self.micros)


def interval(text: str) -> Interval:
    """Parse ``1mo2d-3h``: a leading minus holds for all, inner ones for their part."""
    body, sign = (text[1:], -1) if text.startswith("-") else (text, 1)
    parts = _PART.findall(body)
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValueError(f"not an interval: {text!r}")
    months = micros = 0
    for n, unit in parts:
        if unit in _MONTHS:
            months += sign * int(n) * _MONTHS[unit]
        elif unit == "ns":
            if int(n) % 1000:
                raise ValueError("an interval is whole microseconds")
            micros += sign * int(n) // 1000
        else:
            micros += sign * int(n) * _MICROS[unit]
    return Interval(months, micros)


NAIVE = "timestamp_ntz"


def micros(c: Column, kind: str = "timestamp") -> Column:
    """Microseconds since 1970: of an instant, or of what a naive value shows."""
    if kind == "timestamp":
        return F.unix_micros(c)
    return F.unix_date(c.cast("date")).cast("bigint") * _MICROS["d"] + clock(c, kind)


def from_micros(c: Column, kind: str = "timestamp") -> Column:
    c = c.cast("bigint")
    if kind == "timestamp":
        return F.timestamp_micros(c)
    if kind == "date":
        return F.date_from_unix_date(F.floor(c / _MICROS["d"]).cast("int"))
    return F.lit("1970-01-01 00:00:00").cast(NAIVE) + F.expr("INTERVAL '0.000001' SECOND") * c


def clock(c: Column, kind: str) -> Column:
    """Microseconds since midnight."""
    if kind == "date":
        return F.lit(0).cast("bigint")
    return (F.hour(c) * 60 + F.minute(c)).cast("bigint") * _MICROS["m"] + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def offset_by(c: Column, by: str | Interval, kind: str = "timestamp") -> Column:
    """Months first, clamped to the month's last day, then the fixed part."""
    i = interval(by) if isinstance(by, str) else by
    moved = c
    if i.months:
        moved = F.add_months(c, i.months) if kind == "date" else c + F.make_ym_interval(F.lit(0), F.lit(i.months))
    if i.micros:
        if kind == "date":
            if i.micros % _MICROS["d"]:
                raise ValueError("a date moves by whole days")
            return F.date_add(moved, i.micros // _MICROS["d"])
        moved = from_micros(micros(moved, kind) + i.micros, kind)
    return moved


def truncate(c: Column, every: str, kind: str = "timestamp") -> Column:
    """The start of the window that holds the value; weeks start on Monday, months are calendar ones."""
    i = interval(every)
    if i.months:
        if i.micros:
            raise ValueError("months and fixed units don't mix here")
        number = F.year(c) * 12 + F.month(c) - 1
        number = number - F.pmod(number, F.lit(i.months))
        start = F.make_date(F.floor(number / 12).cast("int"), (F.pmod(number, F.lit(12)) + 1).cast("int"), F.lit(1))
        return start.cast(kind)
    # 1970-01-05 was a Monday.
    origin = 4 if i.micros % _MICROS["w"] == 0 else 0
    if i.micros % _MICROS["d"] == 0:
        n = i.micros // _MICROS["d"]
        day = F.unix_date(c.cast("date")) - origin
        return F.date_from_unix_date((day - F.pmod(day, F.lit(n)) + origin).cast("int")).cast(kind)
    t = micros(c, kind)
    return from_micros(t - F.pmod(t, F.lit(i.micros)), kind)


def round_to(c: Column, every: str, kind: str = "timestamp") -> Column:
    """Half a window later, then truncated."""
    i = interval(every)
    own = NAIVE if kind == "date" else kind
    c = c.cast(own)
    if i.months:
        low = truncate(c, every, own)
        high = offset_by(low, Interval(i.months, 0), own)
        return F.when(micros(c, own) - micros(low, own) >= micros(high, own) - micros(c, own), high).otherwise(low).cast(kind)
    return truncate(from_micros(micros(c, own) + i.micros // 2, own), every, own).cast(kind)


def weekday(c: Column) -> Column:
    return F.weekday(c) + 1


def iso_year(c: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), c)


def millisecond(c: Column, kind: str = "timestamp") -> Column:
    return F.floor(F.pmod(micros(c, kind), F.lit(1_000_000)) / 1000).cast("int")


def microsecond(c: Column, kind: str = "timestamp") -> Column:
    return F.pmod(micros(c, kind), F.lit(1_000_000)).cast("int")


def nanosecond(c: Column, kind: str = "timestamp") -> Column:
    """Of the second; types are whole microseconds, so the last three digits are 0."""
    return microsecond(c, kind) * 1000


def century(c: Column) -> Column:
    return F.ceil(F.year(c) / 100).cast("int")


def millennium(c: Column) -> Column:
    return F.ceil(F.year(c) / 1000).cast("int")


def is_leap_year(c: Column) -> Column:
    y = F.year(c)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def month_start(c: Column, kind: str = "timestamp") -> Column:
    return _with_time(F.trunc(c.cast("date"), "month"), c, kind)


def month_end(c: Column, kind: str = "timestamp") -> Column:
    return _with_time(F.last_day(c.cast("date")), c, kind)


def _with_time(day: Column, c: Column, kind: str) -> Column:
    if kind == "date":
        return day
    # Calendar days of the same clock: for instants, in the session's zone.
    return c + F.make_dt_interval(F.datediff(day, c.cast("date")))


def time_of_day(c: Column, kind: str = "timestamp") -> Column:
    """Nanoseconds since midnight, on a naive value's clock or an instant's in the session's zone."""
    return clock(c, kind) * 1000


def epoch(c: Column, unit: str, kind: str = "timestamp") -> Column:
    if unit == "d":
        return F.unix_date(c.cast("date")).cast("bigint")
    t = micros(c, kind)
    if unit == "ns":
        return t * 1000
    size = {"s": 1_000_000, "ms": 1_000, "us": 1}[unit]
    return t if size == 1 else ((t - F.pmod(t, F.lit(size))) / size).cast("bigint")


def total(duration: Column, unit: str) -> Column:
    """Whole units of an interval, towards zero."""
    t = (F.extract(F.lit("DAY"), duration).cast("bigint") * _MICROS["d"] + F.extract(F.lit("HOUR"), duration) * _MICROS["h"] + F.extract(F.lit("MINUTE"), duration) * _MICROS["m"] + (F.extract(F.lit("SECOND"), duration) * 1_000_000).cast("bigint")).cast("bigint")
    size = {"days": _MICROS["d"], "hours": _MICROS["h"], "minutes": _MICROS["m"], "seconds": _MICROS["s"], "milliseconds": _MICROS["ms"], "microseconds": 1}[unit]
    return (F.signum(t) * F.floor(F.abs(t) / size)).cast("bigint")


#: Directives and the patterns that mean the same.
DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "y": "yy", "I": "hh", "p": "a", "f": "SSSSSS", "z": "xx", "Z": "z", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}


def java_pattern(fmt: str) -> str:
    """A %-format as a datetime pattern; other letters are quoted."""
    out = []
    for m in re.finditer(r"%(.)|([A-Za-z]+)|(.)", fmt, re.S):
        if m[1]:
            if m[1] == "%":
                out.append("%")
            elif m[1] not in DIRECTIVES:
                raise ValueError(f"no pattern for %{m[1]}")
            else:
                out.append(DIRECTIVES[m[1]])
        elif m[2]:
            out.append(f"'{m[2]}'")
        else:
            out.append("''" if m[3] == "'" else m[3])
    return "".join(out)


def strftime(c: Column, fmt: str) -> Column:
    """``%e``, ``%u``, ``%U`` and ``%W`` have no pattern and are computed."""
    special = {"e": lambda: F.lpad(F.dayofmonth(c).cast("string"), 2, " "), "u": lambda: weekday(c).cast("string"), "U": lambda: _week_number(c, 0), "W": lambda: _week_number(c, 1)}
    parts = [p for p in re.split(r"(%[euUW])", fmt) if p]
    columns = [special[p[1]]() if re.fullmatch(r"%[euUW]", p) else F.date_format(c, java_pattern(p)) for p in parts]
    return F.concat(*columns) if columns else F.lit("")


def _week_number(c: Column, first: int) -> Column:
    day = F.pmod(F.dayofweek(c) - 1 - first, F.lit(7))
    return F.lpad(F.floor((F.dayofyear(c) + 6 - day) / 7).cast("string"), 2, "0")


def strptime(c: Column, fmt: str, kind: str = "timestamp", strict: bool = True) -> Column:
    """A text as a date or time; what doesn't fit raises, or is null unless ``strict``."""
    pattern = java_pattern(fmt)
    zoned = bool(re.search(r"%[zZ]", fmt))
    # A naive text is read as of UTC and shown as of UTC, so that no clock skips it.
    text, read = (c, pattern) if zoned or kind == "timestamp" else (F.concat(c, F.lit(" UTC")), pattern + " VV")
    got = F.to_timestamp(text, read) if strict else F.try_to_timestamp(text, F.lit(read))
    if kind == "timestamp":
        return got
    return from_micros(F.unix_micros(got), kind)


def business_days_since(c: Column, week_mask: tuple[bool, ...], holidays: list[str]) -> Column:
    """Business days in [1970-01-05, date): whole weeks, the days of the last one, less holidays."""
    days = F.unix_date(c.cast("date")) - 4
    weeks, rest = F.floor(days / 7), F.pmod(days, F.lit(7))
    before = [sum(week_mask[:k]) for k in range(7)]
    n = weeks * sum(week_mask) + F.element_at(F.array(*[F.lit(x) for x in before]), rest.cast("int") + 1)
    off = [F.lit(h).cast("date") for h in sorted(set(holidays))]
    if off:
        worked = F.filter(F.array(*off), lambda h: F.element_at(F.array(*[F.lit(x) for x in week_mask]), F.weekday(h) + 1))
        floor = F.lit("1970-01-05").cast("date")
        n = n - F.size(F.filter(worked, lambda h: (h >= floor) & (h < c.cast("date")))) + F.size(F.filter(worked, lambda h: (h < floor) & (h >= c.cast("date"))))
    return n.cast("bigint")


WEEKDAYS = (True, True, True, True, True, False, False)


def business_day_count(start: Column, end: Column, week_mask: tuple[bool, ...] = WEEKDAYS, holidays: list[str] = ()) -> Column:
    """Business days from start up to but without end; negative backward, where start counts too."""
    since = lambda c: business_days_since(c, week_mask, list(holidays))
    return F.when(end >= start, since(end) - since(start)).otherwise(since(F.date_add(end, 1)) - since(F.date_add(start, 1)))


def is_business_day(c: Column, week_mask: tuple[bool, ...] = WEEKDAYS, holidays: list[str] = ()) -> Column:
    works = F.element_at(F.array(*[F.lit(x) for x in week_mask]), F.weekday(c) + 1)
    off = [F.lit(h).cast("date") for h in holidays]
    return works & ~c.cast("date").isin(*off) if off else works


def add_business_days(c: Column, n: int, week_mask: tuple[bool, ...] = WEEKDAYS, holidays: list[str] = (), roll: str = "raise") -> Column:
    """The n-th business day from a business day; others roll ``forward`` or ``backward`` first, or raise."""
    d = c.cast("date")
    span = 7 + 2 * len(holidays)

    def nearest(x: Column, step: int) -> Column:
        days = F.filter(F.transform(F.sequence(F.lit(0), F.lit(span)), lambda k: F.date_add(x, (k * step).cast("int"))), lambda y: is_business_day(y, week_mask, holidays))
        return F.element_at(days, 1)

    if roll == "raise":
        start = F.when(is_business_day(d, week_mask, holidays), d).when(d.isNotNull(), F.raise_error(F.lit("not a business day")).cast("date"))
    else:
        start = nearest(d, 1 if roll == "forward" else -1)
    # Enough calendar days for n business days, in one sequence.
    per_week = max(1, sum(week_mask))
    reach = (abs(n) // per_week + 1) * 7 + span
    step = 1 if n >= 0 else -1
    days = F.filter(F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda k: F.date_add(start, (k * step).cast("int"))), lambda y: is_business_day(y, week_mask, holidays))
    return F.element_at(days, abs(n) + 1)


def replace_time_zone(c: Column, zone: str, ambiguous: str = "raise", non_existent: str = "raise", kind: str = NAIVE) -> Column:
    """The instant at which clocks of ``zone`` show a naive time.

    ``ambiguous``: raise, earliest, latest or null, for times that clocks show twice;
    ``non_existent``: raise or null, for those that they skip.
    """
    # An instant whose UTC clock shows the naive time; the zone functions move it by the zone's offset.
    shown = F.timestamp_micros(micros(c, kind))
    first = F.to_utc_timestamp(shown, zone)
    clock_at = lambda x: micros(F.from_utc_timestamp(x, zone))
    # The offsets of a day before and after are those on either side of a change, whatever its size.
    sides = []
    for day in (-_MICROS["d"], _MICROS["d"]):
        at = F.timestamp_micros(micros(first) + day)
        sides.append(F.timestamp_micros(micros(shown) - (clock_at(at) - micros(at))))
    fits = [F.when(clock_at(x) == micros(shown), x) for x in (first, *sides)]
    early, late = F.least(*fits), F.greatest(*fits)
    alarm = lambda text: F.raise_error(F.lit(text)).cast("timestamp")
    twice = {"raise": alarm("ambiguous time"), "earliest": early, "latest": late, "null": F.lit(None).cast("timestamp")}[ambiguous]
    gap = {"raise": alarm("time does not exist"), "null": F.lit(None).cast("timestamp")}[non_existent]
    return F.when(early.isNull() & c.isNotNull(), gap).when(early != late, twice).otherwise(early)


def convert_time_zone(c: Column, zone: str, kind: str = "timestamp") -> Column:
    """What clocks of ``zone`` show at an instant; a naive value counts as of UTC."""
    at = F.timestamp_micros(micros(c, kind))
    return from_micros(micros(F.from_utc_timestamp(at, zone)), NAIVE)
