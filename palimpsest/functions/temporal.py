"""Date and time scalars. Every one takes its clock as an argument; none reads the system's."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


def seconds_between(later: Column, earlier: Column) -> Column:
    """Fractional seconds."""
    as_seconds = lambda t: F.unix_micros(t.cast("timestamp")) / 1e6
    return as_seconds(later) - as_seconds(earlier)


def days_until(target: Column, now: Column) -> Column:
    return seconds_between(target, now) / 86400.0


def proximity(target: Column, now: Column) -> Column:
    """13 wordings of a distance in time; counts are rounded half to even."""
    d = days_until(target, now)
    size, ahead = F.abs(d), d > 0

    def counted(n: Column, unit: Column) -> Column:
        text = F.concat(n.cast("string"), F.lit(" "), unit)
        return F.when(ahead, F.concat(F.lit("in "), text)).otherwise(F.concat(text, F.lit(" ago")))

    def plural(per: float, unit: str) -> Column:
        n = F.bround(size / per).cast("long")
        return counted(n, F.when(n == 1, F.lit(unit)).otherwise(F.lit(unit + "s")))

    return (
        F.when(size < 0.04, "right now")
        .when(size < 1, F.when(ahead, "today").otherwise("earlier today"))
        .when(size < 2, F.when(ahead, "tomorrow").otherwise("yesterday"))
        .when(size < 7, counted(F.bround(size).cast("long"), F.lit("days")))
        .when(size < 30, plural(7.0, "week"))
        .when(size < 365, plural(30.0, "month"))
        .when(size.isNotNull(), plural(365.0, "year"))
    )


def humanize(seconds: Column) -> Column:
    """Six wordings of a span, by whole units."""
    steps = [(60, None, None), (3600, 60, "minute"), (86400, 3600, "hour"), (604800, 86400, "day"), (2592000, 604800, "week")]
    out = F.when(seconds < 60, F.lit("just now"))
    for below, per, unit in steps[1:]:
        n = F.floor(seconds / per)
        out = out.when(seconds < below, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s")))
    n = F.floor(seconds / 2592000)
    return out.when(seconds.isNotNull(), F.concat(n.cast("string"), F.lit(" month"), F.when(n == 1, "").otherwise("s")))


def staleness(at: Column, now: Column) -> Column:
    """exp(-age / 30 days); 1 without a time or for one ahead."""
    age = seconds_between(now, at)
    return F.when(age.isNull() | (age <= 0), F.lit(1.0)).otherwise(F.exp(-age / 2592000.0))


def is_before(a: Column, b: Column) -> Column:
    return a < b


def duration_between(a: Column, b: Column) -> Column:
    return F.abs(seconds_between(a, b))


def _weekday(word: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, DAYS)), word).cast("int") - 1


def resolve_date(expression: Column, reference: Column, sentence: Column | None = None) -> Column:
    """The date a relative or partial expression names, seen from ``reference``; null if it names none. Words match whole:
    months, days and numbers are closed lists. A bare weekday lies ahead if the sentence says so (on, this or coming before
    it, or will or going to anywhere), else behind; a named day is never the reference's own day but one 7 days away."""
    e = F.lower(F.trim(expression))
    said = F.lower(sentence) if sentence is not None else e
    day = F.date_trunc("day", reference).cast("timestamp_ntz")
    shift = lambda n: (F.to_date(day) + n.cast("int")).cast("timestamp_ntz")
    today = F.weekday(day)
    names, months = "|".join(DAYS), "|".join(MONTHS)
    asked = F.regexp_extract(e, rf"\b({names})\b", 1)
    wanted = _weekday(asked)
    ahead = F.pmod(wanted - today, F.lit(7))
    ahead = F.when(ahead == 0, 7).otherwise(ahead)
    behind = F.pmod(today - wanted, F.lit(7))
    behind = F.when(behind == 0, 7).otherwise(behind)
    forward = said.rlike(rf"\b(on|this|coming) ({names})\b") | said.rlike(r"\b(will|going to)\b")
    count = F.regexp_extract(e, rf"\b(\d+|an?|{'|'.join(NUMBERS)}) (day|week|month|year)s? ago\b", 1)
    unit = F.regexp_extract(e, rf"\b(\d+|an?|{'|'.join(NUMBERS)}) (day|week|month|year)s? ago\b", 2)
    word = F.array_position(F.array(*map(F.lit, NUMBERS)), count).cast("int")
    n = F.when(count.isin("a", "an"), 1).when(word > 0, word).otherwise(F.expr("null").cast("int"))
    n = F.coalesce(n, F.when(count.rlike(r"^\d{1,6}$"), F.regexp_extract(count, r"(\d{0,6})", 1).try_cast("int")))
    month_name = F.regexp_extract(e, rf"\b({months})\b", 1)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), month_name).cast("int")
    year_of = F.regexp_extract(e, r"\b((?:19|20)\d\d)\b", 1)
    year = F.coalesce(year_of.try_cast("int"), F.year(day))
    dated = F.coalesce(F.regexp_extract(e, rf"\b(\d{{1,2}})(?:st|nd|rd|th)? (?:of )?(?:{months})\b", 1).try_cast("int"), F.regexp_extract(e, rf"\b(?:{months}) (\d{{1,2}})(?:st|nd|rd|th)?\b", 1).try_cast("int"), F.lit(1))
    made = F.try_make_timestamp_ntz(year, month, dated, F.lit(0), F.lit(0), F.lit(0)) if hasattr(F, "try_make_timestamp_ntz") else F.make_timestamp_ntz(year, month, F.least(dated, F.lit(28)), F.lit(0), F.lit(0), F.lit(0))
    last_month = F.add_months(F.trunc(day, "month"), -1)
    return (
        F.when(e.rlike(r"\byesterday\b"), shift(F.lit(-1)))
        .when(e.rlike(r"\btoday\b"), day)
        .when(e.rlike(r"\btomorrow\b"), shift(F.lit(1)))
        .when(e.rlike(rf"\b(last|past) ({names})\b"), shift(-behind))
        .when(e.rlike(rf"\bnext ({names})\b"), shift(ahead))
        .when(asked != "", shift(F.when(forward, ahead).otherwise(-behind)))
        .when(e.rlike(r"\blast week\b"), shift(F.lit(-7)))
        .when(e.rlike(r"\blast month\b"), (last_month + (F.least(F.dayofmonth(day), F.lit(28)) - 1)).cast("timestamp_ntz"))
        .when((unit == "day") & n.isNotNull(), shift(-n))
        .when((unit == "week") & n.isNotNull(), shift(-7 * n))
        .when((unit == "month") & n.isNotNull(), F.add_months(F.to_date(day), -n).cast("timestamp_ntz"))
        .when((unit == "year") & n.isNotNull(), F.add_months(F.to_date(day), -12 * n).cast("timestamp_ntz"))
        .when(month_name != "", made)
        .when(e.rlike(r"^(19|20)\d\d$"), F.make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    )


def specificity(at: Column) -> Column:
    """0 to 3: a date beyond 1 January, a day beyond the first, a time of day."""
    return F.when((F.month(at) != 1) | (F.dayofmonth(at) != 1), 1).otherwise(0) + F.when(F.dayofmonth(at) != 1, 1).otherwise(0) + F.when((F.hour(at) != 0) | (F.minute(at) != 0) | (F.second(at) != 0), 1).otherwise(0)


def most_specific(dates: Column) -> Column:
    """Of an array of dates, the most specific; of equals, the first."""
    scored = F.transform(F.filter(dates, lambda d: d.isNotNull()), lambda d, i: F.struct(specificity(d).alias("s"), (-i).alias("i"), d.alias("d")))
    return F.array_max(scored)["d"]


def waterfall(*dates: Column) -> Column:
    """The first date known: text, expression, pre-resolved, session."""
    return F.coalesce(*dates)


def to_datetime(value: Column, reference: Column) -> Column:
    """An ISO string (a trailing Z is dropped), else what the expression resolves to."""
    plain = F.regexp_replace(value, r"Z$", "")
    iso = F.when(plain.rlike(r"^\s*\d{4}-\d"), plain).try_cast("timestamp_ntz")  # the cast itself knows words like "today"
    return F.coalesce(iso, resolve_date(value, reference))


def session_timestamp(value: Column) -> Column:
    """Stamps like ``1:56 pm on 8 May, 2023``."""
    pattern = r"(?i)^\s*(\d{1,2}:\d{2})\s*(am|pm) on (\d{1,2}) ([a-z]+),? (\d{4})\s*$"
    parts = F.concat_ws(" ", F.regexp_extract(value, pattern, 1), F.upper(F.regexp_extract(value, pattern, 2)), F.regexp_extract(value, pattern, 3), F.initcap(F.regexp_extract(value, pattern, 4)), F.regexp_extract(value, pattern, 5))
    return F.when(value.rlike(pattern), F.try_to_timestamp(parts, F.lit("h:mm a d MMMM yyyy")).cast("timestamp_ntz"))


def rendered(at: Column) -> Column:
    """``Month YYYY``, or the year alone for 1 January."""
    return F.when((F.month(at) == 1) & (F.dayofmonth(at) == 1), F.year(at).cast("string")).otherwise(F.date_format(at, "MMMM yyyy"))


def is_duration(span: Column, before: Column | None = None) -> Column:
    """Spans that tell a length rather than a time: two words or more that end in a unit without ago, last, next or this;
    or any after ``for``."""
    s = F.lower(F.trim(span))
    long = F.size(F.split(s, r"\s+")) >= 2
    own = long & s.rlike(r"\b(seconds?|minutes?|hours?|days?|weeks?|months?|years?)$") & ~s.rlike(r"\b(ago|last|next|this)\b")
    return own | (F.lower(F.trim(before)) == "for" if before is not None else F.lit(False))


def hours_any(at: Column, hours: list[int]) -> Column:
    return reduce(lambda a, h: a | (F.hour(at) == h), hours, F.lit(False))


def since_seconds(sentence: Column, reference: Column) -> Column:
    """The length a sentence names: ``for`` a count of units, or ``since`` a date up to the reference."""
    s = F.lower(sentence)
    count = F.regexp_extract(s, rf"\bfor (\d+|an?|{'|'.join(NUMBERS)}) (second|minute|hour|day|week|month|year)s?\b", 1)
    unit = F.regexp_extract(s, rf"\bfor (\d+|an?|{'|'.join(NUMBERS)}) (second|minute|hour|day|week|month|year)s?\b", 2)
    word = F.array_position(F.array(*map(F.lit, NUMBERS)), count).cast("int")
    n = F.when(count.isin("a", "an"), 1).when(word > 0, word).otherwise(F.nullif(count, F.lit("")).try_cast("int"))
    sizes = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}
    per = F.try_element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), unit)
    start = resolve_date(F.nullif(F.regexp_extract(s, r"\bsince (.+?)[.?!]?$", 1), F.lit("")), reference)
    return F.coalesce((n * per).cast("double"), F.abs(seconds_between(reference, start)))


_COUNT = rf"(?:\d+|an?|{'|'.join(NUMBERS)})"
#: What names a time, by kind; matched in lower case.
SPANS = {
    "day": r"\b(?:yesterday|today|tomorrow|tonight)\b",
    "weekday": rf"\b(?:(?:last|past|next|this|coming) )?(?:{'|'.join(DAYS)})\b",
    "period": r"\b(?:last|past|next|this) (?:week|month|year)\b",
    "ago": rf"\b{_COUNT} (?:day|week|month|year)s? ago\b",
    "length": rf"\b{_COUNT} (?:second|minute|hour|day|week|month|year)s?\b",
    "month": rf"\b(?:\d{{1,2}}(?:st|nd|rd|th)? (?:of )?)?(?:{'|'.join(MONTHS)})(?: \d{{1,2}}(?:st|nd|rd|th)?)?(?:,? (?:19|20)\d\d)?\b",
    "year": r"\b(?:19|20)\d\d\b",
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(low: Column, pattern: str) -> Column:
    """``array<struct<start, end>>`` of all matches, from 0."""
    size = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    start = lambda m, i: size(m["between"], i + 1) + size(m["found"], i)
    place = lambda x, at: F.struct(at.alias("start"), (at + F.length(x)).alias("end"))
    every = lambda m: F.transform(m["found"], lambda x, i: _let(start(m, i), lambda at: place(x, at)))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return _let(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) > 0, _let(F.struct(f.alias("found"), F.split(low, pattern).alias("between")), every)).when(f.isNotNull(), none))


def date_spans(said: Column) -> Column:
    """``array<struct<start, end, span>>``: all spans of time in a text, in order; those that overlap are one, by a running maximum
    of their ends over their starts."""
    every = _let(F.lower(said), lambda low: F.sort_array(F.concat(*[_places(low, p) for p in SPANS.values()])))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def grown(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (x["start"] < last["end"]), joined).otherwise(F.concat(done, F.array(x)))

    merged = F.aggregate(every, none, grown)
    return F.transform(merged, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.substring(said, x["start"] + 1, x["end"] - x["start"]).alias("span")))


def dated_spans(said: Column, reference: Column, spans: Column | None = None) -> Column:
    """``array<struct<start, end, span, date>>``: spans that tell a time rather than a length, and name a date; ``spans`` if they are
    known."""
    before = lambda x: F.regexp_extract(F.left(said, x["start"]), r"(\w+)\W*$", 1)
    times = F.filter(date_spans(said) if spans is None else spans, lambda x: ~is_duration(x["span"], before(x)))
    return F.filter(F.transform(times, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["span"].alias("span"), resolve_date(x["span"], reference, said).alias("date"))), lambda x: x["date"].isNotNull())


def event_date(said: Column, reference: Column, spans: Column | None = None) -> Column:
    """The most specific date that a text names; of equals, the first."""
    return most_specific(F.transform(dated_spans(said, reference, spans), lambda x: x["date"]))
