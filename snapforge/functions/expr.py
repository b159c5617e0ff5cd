"""Column helpers: ratios, tiers, labels, codes, JSON lists, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language codes and names: fixed values.
LANGUAGES = {
    "en": "English", "es": "Spanish", "fr": "French", "de": "German", "it": "Italian", "pt": "Portuguese", "ja": "Japanese", "ko": "Korean", "ru": "Russian",
    "zhs": "Chinese Simplified", "zht": "Chinese Traditional", "he": "Hebrew", "la": "Latin", "grc": "Ancient Greek", "ar": "Arabic", "sa": "Sanskrit", "ph": "Phyrexian", "qya": "Quenya",
}
#: Ordinals of rarities: fixed values; others are null.
RARITIES = {"common": 0, "uncommon": 1, "rare": 2, "mythic": 3}
#: Date formats of event lists, in the order in which they are tried.
DATE_FORMATS = ("dd/MM/yy", "MM/dd/yy", "MMM dd yy", "dd MMM yy")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))


def log_return(now: Column, later: Column) -> Column:
    return F.log1p(later) - F.log1p(now)


def inverse_log_return(price: Column, r: Column) -> Column:
    return F.expm1(F.log1p(price) + r)


def tier(price: Column) -> Column:
    """1 below 100 and for null, 2 below 1000, else 3."""
    return F.when(price >= 1000, 3).when(price >= 100, 2).otherwise(1)


def direction(now: Column, later: Column, up: float = 1.2, down: float = 0.8) -> Column:
    """up, down or flat, strictly beyond the factors; null if either price is."""
    return F.when(now.isNull() | later.isNull(), None).when(later > now * up, "up").when(later < now * down, "down").otherwise("flat")


def lookup(code: Column, names: dict) -> Column:
    """The name of a code; other codes stay as they are."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[code], code)


def ordinal(value: Column, order: dict[str, int] = RARITIES) -> Column:
    return F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.lower(value)]


def flag(value: Column) -> Column:
    return F.coalesce(value.cast("boolean"), F.lit(False))


def capped(value: Column, most: float = 20) -> Column:
    return F.when(value <= most, value)


def cleaned(text: Column, sentinel: str = "_") -> Column:
    return F.nullif(F.trim(text), F.lit(sentinel))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def json_list(text: Column, case=None) -> Column:
    """The items of a JSON list, nested ones as JSON text; null and what isn't a list give no items."""
    items = F.coalesce(F.from_json(F.coalesce(text, F.lit("[]")), "array<string>"), F.array().cast("array<string>"))
    return F.transform(items, case) if case else items


def type_parts(line: Column, known: list[str]) -> Column:
    """Of the words before the dash those that are known."""
    return F.filter(F.split(F.split_part(line, F.lit(" — "), F.lit(1)), " "), lambda w: F.array_contains(F.array(*map(F.lit, known)), w))


def subtypes(line: Column) -> Column:
    return F.when(F.position(F.lit(" — "), line) > 0, F.split(F.split_part(line, F.lit(" — "), F.lit(2)), " ")).otherwise(F.array().cast("array<string>"))


def any_date(text: Column) -> Column:
    """By the first format that fits. Years of two digits lie in 1969 to 2068."""
    d = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]).cast("date")
    return F.when(F.year(d) > 2068, F.add_months(d, -1200)).otherwise(d)


def reason(confidence: Column) -> Column:
    return F.format_string("ML predicts +%.0f%% in 7d", F.bround((confidence - 1) * 100, 0))  # halves to the even number
