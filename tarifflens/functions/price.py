"""Prices, currencies, dates and their checks, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import YEAR, clean, without_price_words

#: Rates to KZT for when no service answers.
FALLBACK_RATES = {"KZT": 1.0, "USD": 470.0, "EUR": 510.0, "RUB": 5.2}
#: What names a currency in a row, by priority.
CURRENCY_SIGNS = (("USD", ("usd", "\\$", "доллар")), ("EUR", ("eur", "€", "евро")), ("RUB", ("rub", "руб")))
#: Texts of reasons, and the change that a note needs.
MISSING, NOT_POSITIVE, LOWER = "price missing or invalid", "price must be > 0", "nonresident price is lower than resident price"
MOST_CHANGE = 0.5
#: How a date stands in a name.
YMD, DMY = "\\d{4}[-_.]\\d{2}[-_.]\\d{2}", "\\d{2}[-_.]\\d{2}[-_.]\\d{4}"
#: Fixed value: the number that a price is read from.
NUMBER = "\\d[\\d\\s]*(?:[.,]\\d+)?"


def parse_price(text: Column) -> Column:
    """The first number, comma as decimal point, of at least 10 and under ten billion; else null."""
    number = F.regexp_extract(without_price_words(text), NUMBER, 0)
    value = F.replace(F.replace(number, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when((value >= 10) & (value < 1e10), value)


def detect_currency(text: Column) -> Column:
    lowered = F.lower(clean(text))
    return reduce(lambda acc, x: F.when(lowered.rlike("|".join(x[1])), x[0]).otherwise(acc), reversed(CURRENCY_SIGNS), F.lit("KZT"))


def fallback_rate(currency: Column) -> Column:
    return reduce(lambda acc, x: F.when(F.upper(currency) == x[0], x[1]).otherwise(acc), FALLBACK_RATES.items(), F.lit(1.0))


def with_rates(rows: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """rows (currency, ...) with rate and rate_source: native for KZT, api for a positive rate of rates (currency, rate), fallback for a fixed one."""
    if rates is None:
        found = rows.withColumn("_rate", F.lit(None).cast("double"))
    else:
        known = rates.where("rate > 0").groupBy(F.upper("currency").alias("_currency")).agg(F.max("rate").cast("double").alias("_rate"))  # as many rows as there are currencies
        found = rows.join(known, F.upper("currency") == F.col("_currency"), "left").drop("_currency")
    native = F.upper("currency") == "KZT"
    source = F.when(native, "native").when(F.col("_rate").isNotNull(), "api").otherwise("fallback")
    rate = F.when(native, 1.0).otherwise(F.coalesce("_rate", fallback_rate(F.col("currency"))))
    return found.withColumns({"rate": rate, "rate_source": source}).drop("_rate")


def in_future(day: Column, today: Column) -> Column:
    return F.coalesce(day > today, F.lit(False))


def to_kzt(value: Column, rate: Column) -> Column:
    return F.bround(value * rate, 2)


def current_price(resident: Column, nonresident: Column, original: Column) -> Column:
    return F.coalesce(resident, original, nonresident)


def change_note(previous: Column, current: Column) -> Column:
    """Null unless the price moved by over half of the previous one."""
    change = F.when(previous > 0, F.abs(current - previous) / previous)
    percent = F.bround(change * 100, 0).cast("bigint").cast("string")
    return F.when(change > MOST_CHANGE, F.concat(F.lit("anomaly: price changed by "), percent, F.lit("% from previous version")))


def price_reasons(resident: Column, nonresident: Column, original: Column) -> Column:
    """Array of what is wrong with the prices."""
    low = F.least(resident, nonresident, original)
    return F.array_compact(F.array(F.when(low.isNull(), MISSING), F.when(low <= 0, NOT_POSITIVE), F.when(nonresident < resident, LOWER)))


def needs_review(service: Column, resident: Column, nonresident: Column, original: Column) -> Column:
    return service.isNull() | (F.size(price_reasons(resident, nonresident, original)) > 0)


def item_needs_review(verified: Column, service: Column, resident: Column, nonresident: Column, original: Column, note: Column) -> Column:
    """Whether a stored item waits for a person."""
    noted = F.coalesce(note, F.lit("")).rlike("anomaly:|price date is in the future")
    return ~F.coalesce(verified, F.lit(False)) & (needs_review(service, resident, nonresident, original) | noted)


def field_flags(name: Column, resident: Column, nonresident: Column, original: Column) -> Column:
    """Struct of booleans: what is wrong with a row's name, its prices together, and each price field."""
    none = F.coalesce(resident, nonresident, original).isNull()
    low = F.coalesce(F.least(resident, nonresident, original) <= 0, F.lit(False))
    lower = F.coalesce(nonresident < resident, F.lit(False))
    field = lambda x: F.coalesce(x <= 0, none)
    flags = {
        "nameless": F.trim(name) == "", "invalid": none | low, "lower": lower,
        "resident_invalid": field(resident), "nonresident_invalid": F.coalesce(nonresident <= 0, F.lit(False)) | lower, "original_invalid": field(original),
    }
    return F.struct(*(x.alias(n) for n, x in flags.items()))


def extract_date(text: Column) -> Column:
    """Year-month-day, else day-month-year, else a year's first day; null if none is valid."""
    ymd = F.try_to_date(F.regexp_replace(F.regexp_extract(text, YMD, 0), "[_.]", "-"), "yyyy-MM-dd")
    dmy = F.try_to_date(F.regexp_replace(F.regexp_extract(text, DMY, 0), "[_.]", "-"), "dd-MM-yyyy")
    year = F.regexp_extract(text, YEAR, 1)
    return F.coalesce(ymd, dmy, F.make_date(year.try_cast("int"), F.lit(1), F.lit(1)))


def as_text(x: Column) -> Column:
    """A double of under 10^20 as text in its shortest form, without an exponent also from 10^7 on."""
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(30,10)").cast("string"), "0+$", ""), "\\.$", ".0")
    return F.when(F.abs(x) < 1e7, x.cast("string")).otherwise(plain)


def parse_input(text: Column) -> Column:
    """A number as a person types it: no spaces, the first comma as point."""
    return F.regexp_replace(F.regexp_replace(text, "(?U)\\s", ""), "^([^,]*),", "$1.").try_cast("double")


def format_money(value: Column) -> Column:
    """Groups of three with spaces, a comma before at most two decimals, a dash for null."""
    shown = F.translate(F.format_number(value, 2), ",.", " ,")
    return F.coalesce(F.regexp_replace(F.regexp_replace(shown, ",(\\d)0$", ",$1"), ",0$", ""), F.lit("—"))


def review_reason(service: Column, resident: Column, nonresident: Column, original: Column, note: Column) -> Column:
    """The first reason that applies, else the note, else a plain request."""
    low = F.least(resident, nonresident, original)
    text = F.coalesce(note, F.lit(""))
    return (
        F.when(service.isNull(), "service match required").when(low.isNull(), MISSING).when(low <= 0, NOT_POSITIVE).when(nonresident < resident, LOWER)
        .when(text.contains("anomaly:"), "price anomaly").when(text.contains("price date is in the future"), "price date is in the future")
        .otherwise(F.coalesce(F.nullif(note, F.lit("")), F.lit("check")))
    )
