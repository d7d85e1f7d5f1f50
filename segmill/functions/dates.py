"""Dates as people write them. The value's shape decides how it is read. The usual shapes are put into year-month-day by one pattern each.
Of any other its time and zone are taken off, the rest falls into one to three parts, and their sizes and names tell which is the year,
the month and the day. No format is tried in vain; nothing runs Python on rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months, and names of days, which carry no information.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
#: Years that a value may have (those of 64-bit nanoseconds).
FIRST_YEAR, LAST_YEAR = 1678, 2261

#: Characters of white space that are cut off at both ends.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_TIME = r"(?:^|(?<=\d)t|[\s,]+)(?:(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?\s*(?:([ap])\.?m\b\.?)?|(\d{1,2})\s*([ap])\.?m\b\.?)"
_ZONE = r"(?:\s*(?:z|utc|gmt|([+-]\d{2}):?(\d{2})?)(?=$|\s))?(?=$|[\s,])"
#: The usual shapes: day-month-year, month/day/year, year first with or without a time, a month's name with day and year.
_YEAR = r"(1[7-9]\d\d|2[01]\d\d|22[0-5]\d)"
_DASHES, _SLASHES = rf"^(\d{{1,2}})-(\d{{1,2}})-{_YEAR}$", rf"^(\d{{1,2}})/(\d{{1,2}})/{_YEAR}$"
_ISO = rf"^{_YEAR}[-/](\d{{1,2}})[-/](\d{{1,2}})([ t](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{{1,6}})?)?$"
_NAMED = rf"^(?:{'|'.join(f'{m[:3]}(?:{m[3:]})?' for m in MONTHS)}) (\d{{1,2}}),? {_YEAR}$"
_NAMED_DAYS = "|".join(f"{d[:3]}(?:{d[3:]})?" for d in WEEKDAYS)
_CUTS = rf"(?:\b(?:{_NAMED_DAYS}|tues|thurs?)\b\.?|(?<=\d)(?:st|nd|rd|th)\b|[\s,./-]|(?<=\d)(?=[a-z])|(?<=[a-z])(?=\d))+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with ``value`` worked out once however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(text: Column) -> Column:
    """The text's parts, each with its text, number, size and the month that it names."""
    names = F.array(*[F.lit(x) for m in MONTHS for x in (m, m[:3], "sept" if m == "september" else m[:3])])

    def one(x: Column) -> Column:
        at = F.array_position(names, x)
        return F.struct(x.alias("s"), x.try_cast("int").alias("n"), F.length(x).alias("l"), F.when(at > 0, F.floor((at - 1) / 3).cast("int") + 1).alias("m"))

    return F.transform(F.filter(F.split(text, _CUTS), lambda x: x != ""), one)


def _year(part: Column) -> Column:
    """Two digits mean the year within fifty years of this one."""
    now = F.year(F.current_date())
    near = now - F.pmod(now, F.lit(100)) + part["n"]
    short = F.when(near >= now + 50, near - 100).when(near < now - 50, near + 100).otherwise(near)
    return F.when(part["l"] == 4, part["n"]).when(part["l"] <= 2, short)


def _three(p: Column, day_first: bool) -> Column:
    """Where the year, the month and the day stand among three parts, as three digits."""
    a, b, c = (F.get(p, F.lit(i)) for i in range(3))
    is_year = lambda x: (x["l"] == 4) | (x["n"] > 31)
    year_first = F.when(((a["l"] < 4) | (b["n"] > 12)) & (c["n"] <= 12), 21).otherwise(12) if day_first else F.lit(12)
    day_before = (a["n"] > 12) | ((b["n"] <= 12) & F.lit(day_first))
    return (
        F.when(a["m"].isNotNull(), F.when(is_year(b), 102).otherwise(201)).when(b["m"].isNotNull(), F.when(is_year(a), 12).otherwise(210))
        .when(c["m"].isNotNull(), F.when(is_year(b), 120).otherwise(21)).when(is_year(a), year_first).when(day_before, 210).otherwise(201)
    )


def _date(p: Column, day_first: bool) -> Column:
    """year, month, day of one to three parts: a year with a month means its first day, eight digits are year, month and day."""
    part = lambda i: F.get(p, i)
    a, b = part(F.lit(0)), part(F.lit(1))
    ymd = lambda y, m, d: F.struct(y.alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))
    three = let(_three(p, day_first), lambda o: ymd(_year(part((o / 100).cast("int"))), let(part((o / 10).cast("int") % 10), lambda x: F.coalesce(x["m"], x["n"])), part(o % 10)["n"]))
    month = lambda x: F.coalesce(x["m"], F.when(x["l"] <= 2, x["n"]))
    two = F.when(a["l"] == 4, ymd(a["n"], month(b), F.lit(1))).when(b["l"] == 4, ymd(b["n"], month(a), F.lit(1)))
    cut = lambda i, n: F.substring(a["s"], i, n).try_cast("int")
    one = F.when(a["l"] == 4, ymd(a["n"], F.lit(1), F.lit(1))).when(a["l"] == 8, ymd(cut(1, 4), cut(5, 2), cut(7, 2)))
    sound = F.forall(p, lambda x: x["s"].rlike(r"^(?:\d{1,4}|\d{8}|[a-z]+)$"))
    return F.when(sound, F.when(F.size(p) == 3, three).when(F.size(p) == 2, two).when(F.size(p) == 1, one))


def _clock(time: Column) -> Column:
    """hour, minute, second, and behind, the minutes of a zone (null without one), of a time's groups."""
    t = lambda i: F.nullif(F.get(time, F.lit(i)), F.lit(""))
    number = lambda i: F.coalesce(t(i), F.lit("0")).try_cast("int")
    hour = F.when(t(4).isNull(), number(0)).when(number(0).between(1, 12), number(0) % 12 + F.when(t(4) == "p", 12).otherwise(0))
    exact = (number(2) + F.rpad(F.coalesce(t(3), F.lit("0")), 6, "0").try_cast("int") / F.lit(1_000_000)).cast("decimal(16,6)")
    behind = F.when(t(5).isNotNull(), F.when(t(5).startswith("-"), -1).otherwise(1) * (F.abs(number(5)) * 60 + number(6)))
    return F.struct(hour.alias("hour"), number(1).alias("minute"), exact.alias("second"), behind.alias("behind"))


def _read(date: Column, time: Column, day_first: bool) -> Column:
    def at(d: Column, c: Column) -> Column:
        fine = d["y"].between(FIRST_YEAR, LAST_YEAR) & (c["hour"] < 24) & (c["second"] < 60)
        local = F.when(fine, F.try_make_timestamp_ntz(d["y"], d["m"], d["d"], c["hour"], c["minute"], c["second"]))
        return local - F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(c["behind"], F.lit(0)))

    return let(let(_parts(date), lambda p: _date(p, day_first)), lambda d: let(let(time, _clock), lambda c: at(d, c)))


def _any_shape(first: Column, day_first: bool) -> Column:
    """Whatever the shape: time off, parts apart. Interpreted, so it is the way of values that no usual shape fits."""
    runs = F.regexp_replace(F.regexp_replace(first, r"^(\d{8})t?(\d{2})(\d{2})$", "$1 $2:$3"), r"^(\d{8})t?(\d{2})(\d{2})(\d{2})$", "$1 $2:$3:$4")
    text = F.regexp_replace(runs, r"^(\d{4}-\d{1,2}-\d{1,2})[t\s](\d{2})$", "$1 $2:00")
    timed = lambda t: t.rlike(r":|\d\s*[ap]\.?m\b")
    none = F.array(*[F.lit("")] * 7)
    groups = lambda t: F.split(F.regexp_replace(t, f"^.*?{_TIME}{_ZONE}.*$", "$1$6|$2|$3|$4|$5$7|$8|$9"), r"\|")
    date = lambda t: F.when(timed(t), F.regexp_replace(t, f"{_TIME}{_ZONE}", " ")).otherwise(t)
    read = lambda t: _read(date(t), F.when(timed(t), groups(t)).otherwise(none), day_first)
    return let(text, lambda t: F.when(t.rlike("^[a-z0-9]"), read(t)))


def _trimmed(c: Column) -> Column:
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def parse_mixed(c: Column, day_first: bool = False) -> Column:
    """timestamp_ntz of a date in any shape. Four-digit years and names decide; else the month comes first unless only the day can
    (``day_first``: the other way round). A time may stand before or after the date, with a.m. or p.m.; a zone is converted to UTC. What
    has no such shape, or isn't a date, is null."""
    return _any_shape(_trimmed(c), day_first)


def parse_date(c: Column) -> Column:
    """As ``parse_mixed``, but bare d-m-yyyy is day first and bare m/d/yyyy month first, whatever else is possible."""
    t = _trimmed(c)
    number = ((F.position(F.substring(t, 1, 3), F.lit("".join(m[:3] for m in MONTHS))) + 2) / 3).cast("int").cast("string")
    named = F.replace(F.regexp_replace(t, _NAMED, "$2-m-$1"), F.lit("m"), number)
    iso = lambda x: x.try_cast("timestamp_ntz")
    return (  # the usual shapes are put into year-month-day by one pattern each
        F.when(t.rlike(_DASHES), iso(F.regexp_replace(t, _DASHES, "$3-$2-$1"))).when(t.rlike(_SLASHES), iso(F.regexp_replace(t, _SLASHES, "$3-$1-$2")))
        .when(t.rlike(_ISO), iso(F.regexp_replace(t, _ISO, "$1-$2-$3$4"))).when(t.rlike(_NAMED), iso(named)).otherwise(_any_shape(t, False))
    )
