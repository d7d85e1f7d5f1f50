"""Column functions over messy strings. None of them runs Python on rows; unreadable values become null, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import BLANKS, parse_date, parse_mixed  # noqa: F401

#: Spellings of missing values, per kind of column, and number words.
QUANTITY_NULLS = ["", "nan", "<na>", "none", "null", "n/a", "na", "unknown"]
ORDER_NULLS = [*QUANTITY_NULLS, "duplicate"]
ID_NULLS = ["nan", "<na>", "none", "null", "n/a", "na", "unknown", "unk", "?", "-"]
NUMBER_WORDS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "dozen": 12}
#: Currency symbols' patterns and ISO codes.
CURRENCY_SYMBOLS = {"BRL": r"R\$", "USD": r"(?<!R)\$", "EUR": "€", "GBP": "£", "JPY": "¥", "INR": "₹", "KRW": "₩", "RUB": "₽"}
CURRENCY_CODES = ["USD", "EUR", "GBP", "JPY", "CNY", "INR", "AUD", "CAD", "KRW", "RUB", "BRL", "CHF"]


def strip(c: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def text_or_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def parse_money(c: Column) -> Column:
    """Digits and points decide; a minus anywhere makes it negative."""
    digits = F.regexp_replace(c, "[^0-9.]", "")
    value = digits.try_cast("double")
    return F.when(F.contains(c, F.lit("-")), -value).otherwise(value)


def parse_quantity(c: Column) -> Column:
    """Number words, else the first number, rounded half to even; negative ones are null."""
    t = F.lower(strip(c))
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    number = F.nullif(F.regexp_extract(t, r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")
    found = F.coalesce(F.try_element_at(words, t).cast("double"), F.when(number >= 0, number))
    return F.when(~t.isin(QUANTITY_NULLS), F.rint(found)).cast("long")


def canonical_customer_id(c: Column) -> Column:
    """The last run of digits without leading zeros, else the letters and digits."""
    t = F.lower(strip(c))
    digits = F.regexp_replace(F.regexp_extract(t, r"(\d+)(?!.*\d)", 1), r"^0+(?=\d)", "")
    key = F.when(t.rlike(r"\d"), digits).otherwise(F.nullif(F.regexp_replace(t, "[^a-z0-9]", ""), F.lit("")))
    return F.when(~t.isin(["", *ID_NULLS]), key)


def normalize_order_id(c: Column) -> Column:
    t = strip(c)
    return F.when(~F.lower(t).isin(ORDER_NULLS), text_or_null(F.regexp_replace(t, "^#+", "")))


def normalize_label(c: Column) -> Column:
    return strip(F.translate(F.lower(c), "-_", "  "))


def round2(c: Column) -> Column:
    """Two decimals, halves of the scaled value to even."""
    return F.rint(c * 100) / 100


def money_sum(c: Column) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(c.cast("decimal(38,8)")).cast("double")


def elapsed_days(since: Column, until: Column) -> Column:
    """Whole periods of 24 hours, rounded down (a start two hours after the end gives -1)."""
    return F.floor(F.timestamp_diff("MICROSECOND", since, until) / F.lit(86_400_000_000)).cast("long")


def nearest_decimal(c: Column, digits: int) -> Column:
    """The decimal with so many digits that is nearest to the double itself (not to its shortest spelling), as C's printf has it. A
    product that seems to lie halfway is judged by its rounding error, which splitting the factor in two gives exactly."""
    scale = float(10**digits)
    product, spread = c * scale, c * 134_217_729.0
    high = spread - (spread - c)
    error = (high * scale - product) + (c - high) * scale
    half = product - F.floor(product) == 0.5
    return F.when(half & (error > 0), F.ceil(product)).when(half & (error < 0), F.floor(product)).otherwise(F.rint(product)) / scale


def format_currency(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(nearest_decimal(F.coalesce(c.try_cast("double"), F.lit(0.0)), 2), 2))


def format_percent(c: Column) -> Column:
    return F.concat(F.format_string("%.1f", nearest_decimal(F.coalesce(c.try_cast("double"), F.lit(0.0)), 1)), F.lit("%"))


def log1p_clipped(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def contains_any(c: Column, patterns: list[str]) -> Column:
    wanted = sorted({p.lower().replace("-", " ").replace("_", " ").strip() for p in patterns})
    return reduce(lambda a, b: a | b, [F.contains(normalize_label(c), F.lit(p)) for p in wanted], F.lit(False))


def currencies(c: Column) -> Column:
    """ISO codes of the currencies that a raw value names; array<string>. A symbol stands for one code, a code for itself."""
    codes = F.regexp_extract_all(c, F.lit(rf"\b({'|'.join(CURRENCY_CODES)})\b"), F.lit(1))
    symbols = F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(code)) for code, p in CURRENCY_SYMBOLS.items()]))
    return F.array_union(codes, symbols)
