"""Column expressions for single values.  All of them stay inside Spark's generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

_NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$|^[-+]?(?i:inf|infinity)$"


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(item) for pair in pairs.items() for item in pair])


def _first_contained(text: Column, pairs) -> Column:
    """Value of the first pair whose key occurs in ``text``; null when none does."""
    return F.coalesce(*[F.when(text.contains(key), F.lit(value)) for key, value in pairs])


def rounded(number: Column, digits: int) -> Column:
    """Round a double the way numeric libraries do: scale up, round, scale back."""
    return F.round(number * 10.0**digits, 0) / 10.0**digits


def blank(text: Column, tokens=tuple(C.NULL_TOKENS)) -> Column:
    """True for null and for the words that stand for null."""
    return text.isNull() | F.lower(F.trim(text)).isin(list(tokens))


def parse_number(text: Column) -> Column:
    """Text to double; null for null tokens and for text that is no number."""
    trimmed = F.trim(text)
    return F.when(~blank(text) & trimmed.rlike(_NUMBER), trimmed.try_cast("double"))


def number_is_bad(text: Column) -> Column:
    """True where a number is written but cannot be read (the row has to be rejected)."""
    return ~blank(text) & parse_number(text).isNull()


def parse_flag(text: Column) -> Column:
    """Text to boolean; null only for unknown words, missing text counts as false."""
    word = F.coalesce(F.lower(F.trim(text)), F.lit(""))
    return F.when(word.isin(C.TRUE_TOKENS), F.lit(True)).when(
        word.isin(C.FALSE_TOKENS), F.lit(False))


def parse_horizon(text: Column) -> Column:
    """``"7"`` and ``"7.0"`` become 7; anything else becomes null."""
    return parse_number(text).try_cast("int")


def fare_class_name(text: Column) -> Column:
    return F.lower(F.trim(text))


def canonical_status(text: Column) -> Column:
    """One of the five canonical statuses; looked up as written, in lower, in upper case."""
    table, raw = _literal_map(C.STATUS_MAP), F.trim(F.coalesce(text, F.lit("")))
    return F.coalesce(table[raw], table[F.lower(raw)], table[F.upper(raw)])


def source_kind(given: Column, scraper: Column) -> Column:
    """``source`` as given, else ``ota`` for agent scrapers and ``airline_direct`` otherwise."""
    agent = reduce(lambda a, b: a | b, [F.lower(scraper).contains(m) for m in C.OTA_MARKERS])
    guess = F.when(agent, F.lit("ota")).otherwise(F.lit("airline_direct"))
    return F.when(blank(given, C.MISSING_TOKENS), guess).otherwise(F.trim(given))


def source_label(given: Column, scraper: Column) -> Column:
    """``source_name`` as given, else the display name for the scraper id."""
    title = F.array_join(F.transform(F.split(scraper, "_"), F.initcap), "_")
    guess = F.coalesce(_first_contained(F.lower(scraper), C.SOURCE_NAMES), title)
    return F.when(blank(given, C.MISSING_TOKENS), guess).otherwise(F.trim(given))


def scraper_from_path(path: Column) -> Column:
    """Scraper id from a capture file's name."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    known = F.coalesce(*[F.when(name.startswith(p), F.lit(s)) for p, s in C.SOURCE_PREFIXES])
    return F.coalesce(known, F.split(F.split(name, "_raw")[0], "_20")[0])


def route_name(origin: Column, destination: Column) -> Column:
    """``A-B``; null when either end is missing."""
    return F.concat(origin, F.lit("-"), destination)


def capture_instant(text: Column) -> Column:
    """ISO text with any offset to an instant."""
    return text.try_cast("timestamp")


def utc_date(text: Column) -> Column:
    """Calendar date in UTC of an ISO text, as ``yyyy-MM-dd``."""
    return F.date_format(capture_instant(text), "yyyy-MM-dd")


def text_date(text: Column) -> Column:
    """First ten characters of the text; the offset is ignored."""
    return F.substring(text, 1, 10)


def weekday_number(day: Column) -> Column:
    """Monday = 0."""
    return F.weekday(day.try_cast("date"))


def carrier_code(flight: Column, name: Column) -> Column:
    """Code from the flight number's prefix, else from the carrier's name, else UNKNOWN."""
    prefix = F.regexp_extract(F.upper(F.trim(flight)), r"^([A-Z0-9]{2})[\s-]*\d+", 1)
    by_prefix = F.when(prefix.isin(list(C.CARRIERS)), prefix)
    by_name = _first_contained(F.lower(F.trim(name)), C.CARRIER_NAME_ORDER)
    return F.coalesce(by_prefix, by_name, F.lit("UNKNOWN"))


def carrier_label(code: Column, name: Column) -> Column:
    """Display name of a resolved code; unknown carriers keep the text they came with."""
    given = F.when(F.length(name) > 0, name)
    return F.coalesce(_literal_map(C.CARRIERS)[code], given, F.lit("Unknown Airline"))


def estimated_base_fare(total: Column) -> Column:
    """Base fare behind a total: fixed fees off, tax off, never below zero, half-even."""
    return F.greatest(F.lit(0.0), F.bround((total - 386) / F.lit(1.05) - 125, 0))


def rupee_amount(text: Column) -> Column:
    """Number in a price text such as ``₹5,432``."""
    return F.regexp_replace(text, r"[^0-9.]", "").try_cast("double")


def chip_fare_class(text: Column) -> Column:
    """Cabin named by a fare chip."""
    return F.when(F.lower(text).rlike("business|stretch"), F.lit("business")).otherwise(
        F.lit("economy"))


def chip_sold_out(text: Column) -> Column:
    return F.lower(text).rlike("sold out|unavailable")


def without_nan(number: Column) -> Column:
    """NaN becomes null, so that later steps only have one kind of missing value."""
    return F.when(~F.isnan(number), number)


def file_key(path: Column) -> Column:
    """Path without scheme and with escapes undone, to compare paths from different readers."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(path, r"^[a-z0-9]+:/+", "/"), r"\+", "%2B"))
