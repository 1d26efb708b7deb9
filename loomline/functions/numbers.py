"""Numbers, sizes and dates over columns. ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def _text(c: Column) -> Column:
    return c.cast("string")


def _whole(c: Column, by: int) -> Column:
    """Whole quotient of an integer, rounded down, in whole numbers."""
    return F.call_function("div", c - F.pmod(c, F.lit(by)), F.lit(by))


def iso_to_epoch(c: Column) -> Column:
    """Seconds of an RFC 3339 time with an offset, else 0."""
    good = c.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
    return F.coalesce(F.when(good, F.unix_seconds(F.try_to_timestamp(F.upper(c)))), F.lit(0))


def days_ago(mtime: Column, now: Column, zone: str = "UTC") -> Column:
    """Calendar days between two epochs, in a zone."""
    local = lambda e: F.to_date(F.from_utc_timestamp(F.timestamp_seconds(e), zone))
    return F.datediff(local(now), local(mtime))


def date_band(mtime: Column, now: Column, zone: str = "UTC") -> Column:
    d = days_ago(mtime, now, zone)
    return F.when(d.isNull(), "earlier").when(d <= 0, "today").when(d == 1, "yesterday").when(d <= 6, "this week").when(d <= 30, "this month").when(d <= 365, "this year").otherwise("older")


def in_range(mtime: Column, now: Column, span: str | int, zone: str = "UTC") -> Column:
    """span: all, today (calendar) or a number of rolling days, inclusive."""
    if span == "all":
        return F.lit(True)
    if span == "today":
        return days_ago(mtime, now, zone) <= 0
    return now - mtime <= int(span) * DAY


def reltime(epoch: Column, now: Column) -> Column:
    d = F.greatest(now - epoch, F.lit(0)).cast("bigint")
    steps = [(90, 1, "s"), (5400, 60, "m"), (129_600, 3600, "h"), (1000 * DAY, DAY, "d")]
    out = F.concat(_text(_whole(d, 31_557_600)), F.lit("y"))
    for below, unit, mark in reversed(steps):
        out = F.when(d < below, F.concat(_text(_whole(d, unit)), F.lit(mark))).otherwise(out)
    return out


def human_dur(secs: Column) -> Column:
    s = secs.cast("bigint")
    two = lambda big, x, small, y: F.concat(_text(_whole(s, big)), F.lit(x), _text(_whole(s % big, small)), F.lit(y))
    return F.when(s <= 0, "-").when(s < 60, F.concat(_text(s), F.lit("s"))).when(s < 3600, F.concat(_text(_whole(s, 60)), F.lit("m"))).when(s < DAY, two(3600, "h", 60, "m")).otherwise(two(DAY, "d", 3600, "h"))


def _shown(v: Column) -> Column:
    """One decimal below ten once rounded, else none; ties to even."""
    one = F.bround(v, 1)
    return F.when(one < 10, F.format_string("%.1f", one)).otherwise(F.format_string("%.0f", F.bround(v, 0)))


def human_size(b: Column, largest: str = "T") -> Column:
    """largest: the unit of all that is larger too, K, M, G or T."""
    d, units = b.cast("double"), "KMGT"
    top = units.index(largest) + 1
    out = F.concat(_shown(d / 1024.0**top), F.lit(largest))
    for i, unit in reversed(list(enumerate(units[: top - 1], 1))):
        v = d / 1024.0**i
        over = F.bround(v, 0) >= 1024  # rounded up to the next unit
        out = F.when((v < 1024) & ~over, F.concat(_shown(v), F.lit(unit))).otherwise(out)
    return F.when(d < 1024, F.concat(_text(b.cast("bigint")), F.lit("B"))).otherwise(out)


def _point(n: Column, places: int, mark: str) -> Column:
    """An integer of 10**-places as a decimal."""
    by = 10**places
    return F.concat(_text(_whole(n, by)), F.lit("."), F.lpad(_text((n % by).cast("bigint")), places, "0"), F.lit(mark))


def _near(n: Column, by: int) -> Column:
    """n / by, halves up, in whole numbers."""
    return _whole(n.cast("bigint") + F.lit(by // 2), by)


def compact_count(n: Column) -> Column:
    k10, k, m10, b10 = _near(n, 100), _near(n, 1000), _near(n, 100_000), _near(n, 100_000_000)
    return F.when(n < 1000, _text(n.cast("bigint"))).when(k10 < 100, _point(k10, 1, "k")).when(k < 1000, F.concat(_text(k), F.lit("k"))).when(m10 < 10_000, _point(m10, 1, "m")).otherwise(_point(b10, 1, "b"))


def _digits(n: Column, unit: int, places: int, mark: str) -> Column:
    """A whole number of more than ``unit`` digits, halves up, as a decimal of 10**unit: digits of its text, so however large it is."""
    s = _text(n + F.lit(5 * 10 ** (unit - places - 1)))
    whole = F.substring(s, F.lit(1), F.length(s) - unit)
    return F.concat(whole, *([F.lit("."), F.substring(s, F.length(s) - (unit - 1), F.lit(places))] if places else []), F.lit(mark))


def human_count(n: Column, largest: str = "t") -> Column:
    """n: whole numbers of 38 digits at most, decimals too; largest: the unit of all that is larger too, b or t."""
    if largest not in ("b", "t"):
        raise ValueError(f"no unit of counts: {largest}")
    n = n.cast("decimal(38,0)")
    large = _digits(n, 9, 2, "b")
    if largest == "t":
        large = F.when(n < 999_995_000_000, large).otherwise(_digits(n, 12, 2, "t"))
    return F.when(n < 1000, _text(n)).when(n < 999_500, _digits(n, 3, 0, "k")).when(n < 999_950_000, _digits(n, 6, 1, "m")).otherwise(large)


def freshness(age_secs: Column) -> Column:
    """1 for now, 0 from 400 days on, by the logarithm of the age."""
    days = F.greatest(age_secs, F.lit(0)) / F.lit(float(DAY))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.log1p(days) / F.log(F.lit(401.0))))


def duration_secs(first: Column, last: Column) -> Column:
    return F.when((first > 0) & (last > first), last - first).otherwise(F.lit(0))


def total_tokens(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def fingerprint(pids: Column) -> Column:
    """Equal for equal sets of processes (an aggregate)."""
    return F.xxhash64(F.sort_array(F.collect_set(pids)))


def semver_key(c: Column) -> Column:
    """Sorts as versions do: numbers, then a release after its pre-releases, whose numeric parts precede names."""
    core, pre = F.regexp_extract(c, r"^v?([0-9.]+)", 1), F.regexp_extract(c, r"^v?[0-9.]+-([^+]*)", 1)
    padded = F.transform(F.split(core, r"\."), lambda x: F.lpad(x, 12, "0"))
    names = F.transform(F.split(pre, r"\."), lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(x, 12, "0"))).otherwise(F.concat(F.lit("1"), x)))
    return F.struct(padded.alias("numbers"), (pre == "").alias("released"), names.alias("pre"))


def boot_time(c: Column) -> Column:
    """Seconds from ``btime N`` or ``sec = N``, else null."""
    return F.coalesce(F.regexp_extract(c, r"(?m)^btime (\d+)", 1).try_cast("bigint"), F.regexp_extract(c, r"sec = (\d+)", 1).try_cast("bigint"))


def same_boot(a: Column, b: Column) -> Column:
    """At most a minute apart; what can't be compared is the same."""
    return F.coalesce(F.abs(boot_time(a) - boot_time(b)) <= 60, F.lit(True))
