"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import fixed

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: What counts as a number in text.
NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: Formats of dates and times in text, in order of preference, each with a form that all its texts have: a text is tried only in formats
#: whose form it has, since each attempt that fails costs an exception.
TIME_FORMATS = [
    ("yyyy-MM-dd HH:mm:ss", r"^\S+ [0-9:]+$"), ("yyyy-MM-dd HH:mm:ss.SSS", r"^\S+ [0-9:]+\.[0-9]{1,3}$"), ("yyyy-MM-dd HH:mm:ss.SSSSSS", r"^\S+ [0-9:]+\.[0-9]{4,6}$"),
    ("yyyy-MM-dd'T'HH:mm:ssXXX", r"(?i)^\S+T[0-9:]+(?:Z|[+-][0-9]+:[0-9]+)$"), ("yyyy-MM-dd'T'HH:mm:ssXX", r"(?i)^\S+T[0-9:]+[+-][0-9]+$"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", r"(?i)^\S+T[0-9:]+\.[0-9]{1,3}(?:Z|[+-][0-9]+:[0-9]+)$"), ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", r"(?i)^\S+T[0-9:]+\.[0-9]{4,6}(?:Z|[+-][0-9]+:[0-9]+)$"),
    ("yyyy-MM-dd'T'HH:mm:ss", r"(?i)^\S+T[0-9:]+$"), ("yyyy-MM-dd'T'HH:mm:ss.SSS", r"(?i)^\S+T[0-9:]+\.[0-9]{1,3}$"),
    ("dd/MMM/yyyy:HH:mm:ss Z", "/"), ("yyyy-MM-dd", "^[^:]+$"),
]
#: Formats of dates, each with the form that a text must have before it is tried.
DATE_FORMATS = [("yyyy-M-d", r"^[0-9]{4,}-"), ("yyyy/M/d", r"^[0-9]{4,}/"), ("M/d/yyyy", r"^[0-9]+/"), ("M-d-yyyy", r"^[0-9]+-")]
NAMED_DATE_FORMATS = [("d MMM yyyy", r"^[0-9]+ [A-Z]"), ("MMM d yyyy", r"^[A-Z]")]


def is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NUMBERS)


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN becomes null, so that one notion of a missing value holds."""
    return df.withColumns({f.name: F.nanvl(quoted(f.name), F.lit(None)) for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))})


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match or with an empty group."""
    return F.get(F.filter(F.array(F.regexp_extract(text, pattern, group)), lambda x: x != ""), F.lit(0))


def first_match(text: Column, patterns: list[str]) -> Column:
    """The first group, trimmed, of the first pattern that matches."""
    return F.coalesce(*[F.trim(extract(text, p)) for p in patterns])


def number(text: Column) -> Column:
    """Text as double; null where it isn't a plain number."""
    return F.when(text.rlike(NUMERIC), F.trim(text).try_cast("double"))


def timestamp(text: Column) -> Column:
    """Text of a known format as UTC time. Text without a zone counts as UTC."""
    clean = F.regexp_replace(F.trim(text), r"\s+", " ")
    return bind(clean, lambda x: F.coalesce(*[F.when(x.rlike(form), F.try_to_timestamp(x, F.lit(f))) for f, form in TIME_FORMATS]))


def syslog_timestamp(text: Column, year: int) -> Column:
    """A time like ``Aug 9 10:07:14`` in the given year; the format has none."""
    return F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(text, r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss"))


def by_form(text: Column, formats: list[tuple[str, str]]) -> list[Column]:
    return [F.when(text.rlike(form), F.try_to_date(text, pattern)) for pattern, form in formats]


def date(text: Column) -> Column:
    """Text of a known date format, the month first where both orders fit."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(text), r"[.,]", ""), r"\s+", " ")
    named = lambda x: F.initcap(F.regexp_replace(x, rf"(?i)\b({fixed.MONTHS})[a-z]*", "$1"))
    return bind(clean, lambda x: F.coalesce(*by_form(x, DATE_FORMATS), bind(named(x), lambda y: F.coalesce(*by_form(y, NAMED_DATE_FORMATS)))))


def iso(time: Column) -> Column:
    """ISO 8601 with an offset; microseconds only where there are any."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ssxxx")
    return F.when(F.date_trunc("second", time) == time, whole).otherwise(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def minute(time: Column) -> Column:
    return F.date_format(F.date_trunc("minute", time), "yyyy-MM-dd'T'HH:mm:00'Z'")


def severity(text: Column) -> Column:
    """The canonical name of a severity; UNKNOWN for others."""
    names = F.create_map(*[F.lit(x) for pair in fixed.SEVERITIES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.upper(F.trim(text))), F.lit("UNKNOWN"))


def severity_rank(name: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in fixed.SEVERITY_RANKS.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, name), F.lit(-1))


def pattern_of(message: Column) -> Column:
    """A message with its variable parts replaced."""
    return reduce(lambda text, part: F.regexp_replace(text, part[0], part[1]), fixed.VARIABLE_PARTS, message)


def domain(value: Column) -> Column:
    """The domain of a mail address or URL, in lower case; empty for missing values."""
    text = F.trim(value.cast("string"))
    bare = F.regexp_replace(F.regexp_replace(text, r"^https?://", ""), r"^www\.", "")
    found = F.when(F.contains(text, F.lit("@")), F.substring_index(text, "@", -1)).otherwise(F.substring_index(bare, "/", 1))
    return F.coalesce(F.lower(found), F.lit(""))


def top_domain(domain: Column) -> Column:
    return F.when(F.contains(domain, F.lit(".")), F.substring_index(domain, ".", -1)).otherwise("")


def is_free_mail(domain: Column) -> Column:
    return F.when(domain.isin(fixed.FREE_MAIL_DOMAINS), "true").otherwise("false")


def personal_data_class(text: Column) -> Column:
    """The first class of personal data that the text has the form of, or null."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for name, p in fixed.PERSONAL_DATA])


def amount(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")
