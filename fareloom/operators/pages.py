"""Quotes and health checks from saved result pages.

A page is one row with its HTML and the search it answers (``origin, destination,
travel_date, advance_purchase_days, scraped_at, capture_run``).  Everything that concerns
one page is worked out on that row, so pages are read without any shuffle; only the in-page
duplicate rule groups rows, by page and flight.  Nested elements are read in Arrow batches
(:mod:`fareloom.functions.markup`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import markup
from ..functions import scalars as S
from .dedup import dedup_in_page
from .filters import agent_status, non_stop_only, plausible_direct, split_alternate_airports

_DROPPED_BLOCKS = ["script", "style", "svg", "noscript", "head", "header", "footer"]
_DROPPED_SINGLE = ["link", "meta"]
SEARCH = ["page_id", "origin", "destination", "travel_date", "advance_purchase_days",
          "scraped_at", "capture_run"]


# --- text helpers -------------------------------------------------------------------

def visible_text(html: Column, separator: str = "") -> Column:
    return F.trim(F.regexp_replace(html, r"(?s)<[^>]*>", separator))


def clean_html(html: Column) -> Column:
    """Drop elements that carry no offers, and comments; the page stays whole at any size."""
    cleaned = html
    for tag in _DROPPED_BLOCKS:
        cleaned = F.regexp_replace(cleaned, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    for tag in _DROPPED_SINGLE:
        cleaned = F.regexp_replace(cleaned, rf"(?is)<{tag}\b[^>]*>", "")
    return F.coalesce(F.regexp_replace(cleaned, r"(?s)<!--.*?-->", ""), F.lit(""))


def card_pieces(html: Column) -> Column:
    """Card-like pieces of a page, at any size: the innermost containers with a time and a currency."""
    return markup.priced_pieces(clean_html(html), C.PIECE_TAGS, C.PIECE_MARKS)


# --- tagged cards -------------------------------------------------------------------

@dataclass(frozen=True)
class CardLayout:
    """Where a site puts the parts of a flight card (class-name patterns)."""

    source: str
    source_name: str
    tag: str
    card: str                     # pattern of the card's class
    fields: tuple[tuple[str, str], ...]
    card_id: str | None = None    # pattern of its id where no class matches
    code: str = C.AGENT_CODE      # flight number inside a card's text
    default_carrier: str = ""


DIRECT_CARDS = CardLayout("airline_direct", "Air India", C.AIRLINE_CARD_TAG, "", tuple(C.AIRLINE_FIELDS.items()),
                          default_carrier="Air India")
AGENT_CARDS = CardLayout("ota", "MakeMyTrip", "div", C.AGENT_CARD, tuple(C.AGENT_FIELDS.items()), C.AGENT_CARD_ID)
SECOND_AGENT_CARDS = CardLayout("ota", "Goibibo", "div", C.SECOND_AGENT_CARD, tuple(C.SECOND_AGENT_FIELDS.items()),
                                C.AGENT_CARD_ID, C.SECOND_AGENT_CODE)


def read_cards(pages: DataFrame, layout: CardLayout) -> DataFrame:
    """One row per card of every page, in page order, with what the card itself says."""
    cards = pages.select(*SEARCH, F.inline(markup.tagged_cards(
        F.col("html"), layout.tag, layout.card, layout.card_id, dict(layout.fields))))
    text, price_text = F.col("text"), F.col("price")
    agent = layout.source == "ota"
    flight, fare = F.col("flight"), S.rupee_amount(price_text)
    if agent:
        flight = F.upper(F.coalesce(F.when(F.length(flight) > 0, flight), F.when(
            text.rlike(f"(?i){layout.code}"), F.regexp_extract(text, f"(?i){layout.code}", 1))))
        marked = F.regexp_extract(text, r"₹\s*([\d,]+)", 1)
        digits = F.regexp_replace(price_text, r"[^\d]", "")
        fare = F.coalesce(S.rupee_amount(marked), F.when(
            F.length(digits) >= 3, digits.try_cast("double")))

    def city(name: str) -> Column:
        shown = F.regexp_extract(name, r"\b([A-Z]{3})\b", 1)
        return F.when(F.length(shown) == 3, shown)

    clock = F.regexp_extract(text, r"\b([0-2]?\d:[0-5]\d)\b", 1)
    return cards.select(
        *SEARCH, "position", flight.alias("flight_num"),
        F.coalesce("carrier", F.lit(layout.default_carrier)).alias("carrier_text"),
        city("departure_city").alias("actual_origin"), city("arrival_city").alias("actual_destination"),
        F.coalesce("time", F.when((F.length(clock) > 0) & F.lit(agent), clock),
                   F.lit("unknown")).alias("departure_time"),
        fare.alias("total_fare"), F.lit(layout.source).alias("source"),
        F.lit(layout.source_name).alias("source_name"))


def extract_cards(pages: DataFrame, layout: CardLayout = DIRECT_CARDS
                  ) -> tuple[DataFrame, DataFrame]:
    """(quotes, discarded): quotes of tagged cards and the counts of other airports' cards."""
    cards = read_cards(pages, layout)
    if layout.source != "ota":
        cards = cards.where(F.col("flight_num").isNotNull())
    kept, discarded = split_alternate_airports(cards)
    code = S.carrier_code(F.col("flight_num"), F.col("carrier_text"))
    if layout.source != "ota":
        # this site sells two carriers under one number range; the operator line decides
        code = F.when(F.col("carrier_text").contains("Express"), F.lit("IX")).otherwise(F.lit("AI"))
    kept = kept.withColumn("carrier_code", code)
    flight = F.coalesce("flight_num", F.concat("carrier_code", F.lit(" UNK")))
    fare = F.col("total_fare")
    good = F.when(fare.isNotNull() & (F.length(flight) > 0), F.lit("ok")).otherwise(
        F.lit("parse_error"))
    kept = kept.withColumns({
        "flight_num": flight,
        "carrier_name": S.carrier_label(F.col("carrier_code"), F.col("carrier_text")),
        "status": agent_status(fare, flight) if layout.source == "ota" else good})
    if layout.source == "ota":
        kept = dedup_in_page(kept, ["page_id", "flight_num", "departure_time"])
    return _as_quotes(kept), discarded


def extract_chips(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(quotes, discarded) of cards with several fare chips: one quote per chip that has a price of its
    own, the cabin from the chip.  A sold-out card gives one row, a card whose chips show no price
    its first price as economy, and one without any price a parse_error row.
    """
    cards = pages.select(*SEARCH, F.inline(markup.chip_cards(F.col("html"), C.CHIP_LAYOUT)))

    def first(name: str, pattern: str) -> Column:
        shown = F.regexp_extract(F.coalesce(name, F.lit("")), pattern, 0)
        return F.when(shown != "", shown)

    number = r"6E\s*[-]?\s*\d{2,4}"
    read = cards.withColumns({
        "actual_origin": first("departure", r"\b[A-Z]{3}\b"), "actual_destination": first("arrival", r"\b[A-Z]{3}\b"),
        "departure_time": F.coalesce(first("departure", r"\b\d{2}:\d{2}\b"), first("text", r"\b\d{2}:\d{2}\b"), F.lit("")),
        "flight_num": F.coalesce(first("text", number), F.lit("IndiGo")), "source_name": F.lit("IndiGo")})
    kept, discarded = split_alternate_airports(read)

    def amount(text: Column) -> Column:
        value = F.regexp_replace(text, r"[^\d.]", "").try_cast("double")
        return F.when(value > 0, value)

    chips = F.filter(F.transform("chips", lambda c: F.struct(
        F.when(F.lower(c["chip"]).rlike("business|stretch"), F.lit("business")).otherwise(F.lit("economy")).alias("fare_class"),
        amount(c["price"]).alias("total_fare"), F.lit("ok").alias("status"))), lambda c: c["total_fare"].isNotNull())

    def single(cabin: str, fare: Column, status: str) -> Column:
        return F.array(F.struct(F.lit(cabin).alias("fare_class"), fare.alias("total_fare"), F.lit(status).alias("status")))

    none, shown = F.lit(None).cast("double"), amount(F.col("first_price"))
    rows = (F.when(F.col("sold_out"), single("", none, "sold_out")).when(F.size(chips) > 0, chips)
            .when(shown.isNotNull(), single("economy", shown, "ok")).otherwise(single("", none, "parse_error")))
    quotes = kept.select("*", F.inline(rows)).withColumns({
        "carrier_code": F.substring("flight_num", 1, 2), "carrier_name": F.lit("IndiGo"), "source": F.lit("airline_direct")})
    return _as_quotes(quotes), discarded


# --- pages without tags -------------------------------------------------------------

def extract_lines(pages: DataFrame, lines_before: int | None = None, lines_after: int | None = None,
                  most_fares: int | None = None) -> DataFrame:
    """Quotes from pages read as plain lines (``page_text``).

    A short line with a flight number opens an offer; its time is the first clock time in the lines
    since the flight before, its fares all distinct amounts in the lines that follow, up to the next
    flight.  The three numbers narrow that for a caller who wants it.  A page without fares gives
    one row that says why.
    """
    flight = r"\bSG\s*[-]?\s*(\d{2,4})\b"
    page = pages.withColumn("_lines", F.filter(
        F.transform(F.split("page_text", "\n"), lambda line: F.trim(line)),
        lambda line: F.length(line) > 0))
    page = page.withColumn("_starts", F.filter(
        F.transform("_lines", lambda line, i: F.when(
            line.rlike(flight) & (F.length(line) < 15), i)), lambda i: i.isNotNull()))
    lines, starts = F.col("_lines"), F.col("_starts")

    def slice_of(first: Column, stop: Column) -> Column:
        return F.slice(lines, first + 1, F.greatest(stop - first, F.lit(0)))

    def offers(start: Column) -> Column:
        previous = F.coalesce(F.array_max(F.filter(starts, lambda i: i < start)) + 1, F.lit(0))
        if lines_before is not None:
            previous = F.greatest(start - lines_before, F.lit(0))
        before = slice_of(previous, start)
        clock = F.get(F.filter(before, lambda t: t.rlike(r"^\d{2}:\d{2}$")), F.lit(0))
        following = F.array_min(F.filter(starts, lambda i: i > start))
        stop = F.least(F.size(lines), following, *([] if lines_after is None else [start + lines_after]))
        positions = F.when(stop > start + 1, F.sequence(start + 1, stop - 1)).otherwise(
            F.array().cast("array<int>"))

        def amount(i: Column) -> Column:
            line = F.get(lines, i)
            marked = (F.get(lines, i - 1) == "₹") | line.contains("₹")
            digits = F.trim(F.regexp_replace(line, "[₹,]", ""))
            value = F.when(marked & digits.rlike(r"^\d+$"), digits.try_cast("double"))
            return F.when(plausible_direct(value), value)

        fares = F.array_distinct(F.array_compact(F.transform(positions, amount)))
        if most_fares is not None:
            fares = F.slice(fares, 1, most_fares)
        number = F.concat(F.lit("SG "), F.regexp_extract(F.get(lines, start), flight, 1))
        return F.transform(fares, lambda fare: F.struct(
            number.alias("flight_num"),
            F.coalesce(clock, F.lit("N/A")).alias("departure_time"), fare.alias("total_fare")))

    closed = F.lower("page_text").rlike("no flights available|unfortunately")
    found = page.withColumn("_offers", F.when(closed, None).otherwise(
        F.flatten(F.transform(starts, offers))))
    reason = F.when(~closed & F.col("page_text").rlike(flight), F.lit("parse_error")).otherwise(
        F.lit("no_flights"))
    rows = (found.withColumn("_reason", reason)
            .select(*SEARCH, "_reason", F.inline_outer("_offers")))
    return _as_quotes(rows.withColumns({
        "status": F.when(F.col("total_fare").isNotNull(), F.lit("ok")).otherwise(F.col("_reason")),
        "flight_num": F.coalesce("flight_num", F.lit("unknown")),
        "departure_time": F.coalesce("departure_time", F.lit("unknown")),
        "carrier_code": F.lit("SG"), "carrier_name": F.lit("SpiceJet"),
        "source": F.lit("airline_direct"), "source_name": F.lit("SpiceJet")}))


def extract_inline(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(quotes, discarded) from pages whose cards read as one run of text.

    The site shows totals only, so base fare and taxes are estimated and marked as such.
    """
    shape = f"(?s){C.INLINE_SHAPE}"
    cards = pages.select(*SEARCH, F.posexplode(markup.run_on_cards(
        F.col("html"), C.INLINE_CARD_CLASSES, C.INLINE_SHAPE)).alias("position", "card_text"))
    part = [F.regexp_extract("card_text", shape, i) for i in range(1, 7)]
    read = cards.select(*SEARCH, "position", "card_text", part[0].alias("flight_num"),
                        part[1].alias("departure_time"), part[2].alias("actual_origin"),
                        part[4].alias("actual_destination"),
                        S.rupee_amount(part[5]).alias("total_fare"),
                        F.lit("Akasa Air").alias("source_name"))
    kept, discarded = split_alternate_airports(read)
    base = S.estimated_base_fare(F.col("total_fare"))
    quotes = non_stop_only(kept).withColumns({
        "status": F.lit("ok"), "carrier_code": F.lit("QP"), "carrier_name": F.lit("Akasa Air"),
        "source": F.lit("airline_direct"), "base_fare": base,
        "taxes_and_fees": F.col("total_fare") - base, "fare_split_estimated": F.lit(True)})
    return _as_quotes(quotes), discarded


def _as_quotes(rows: DataFrame) -> DataFrame:
    """Common columns of extracted quotes."""
    empty = F.lit(None).cast("double")
    has = set(rows.columns)
    return rows.select(
        *SEARCH, "carrier_code", "carrier_name", "flight_num",
        F.col("fare_class") if "fare_class" in has else F.lit("economy").alias("fare_class"),
        *[F.col(n) if n in has else empty.alias(n) for n in ("base_fare", "taxes_and_fees")],
        "total_fare",
        (F.col("fare_split_estimated") if "fare_split_estimated" in has else F.lit(False))
        .alias("fare_split_estimated"),
        "departure_time", "status", "source", "source_name")


def with_placeholders(requests: DataFrame, quotes: DataFrame,
                      status: str = "no_flights_or_timeout") -> DataFrame:
    """Quotes plus one placeholder row for every search that gave none."""
    silent = requests.join(quotes.select("page_id"), "page_id", "left_anti")
    fixed = {"carrier_code": "unknown", "carrier_name": "unknown", "flight_num": "unknown",
             "fare_class": "economy", "departure_time": "unknown", "status": status,
             "source": "airline_direct", "source_name": "unknown"}
    rows = silent.select(
        *SEARCH, *[F.coalesce(F.col(n) if n in silent.columns else F.lit(None), F.lit(v)).alias(n)
                   for n, v in fixed.items()], F.lit(False).alias("fare_split_estimated"))
    return quotes.unionByName(rows, allowMissingColumns=True)


# --- health -------------------------------------------------------------------------

def _reads_like(wording: str):
    return lambda text: text.rlike(wording)


def extraction_health(pages: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """Does each field's element still match a sensible number of times on every page?

    ``rules`` maps a field to (element pattern with one group for its content, text pattern).
    Healthy means 2 to 20 matches of which at least one reads like the field.
    """
    low, high = C.MATCH_BAND
    checks = []
    for field, (element, wording) in rules.items():
        texts = F.transform(F.regexp_extract_all("html", F.lit(element), F.lit(1)),
                            lambda t: visible_text(t))
        count = F.size(texts)
        fits = F.exists(texts, _reads_like(wording))
        reason = (F.when(count < low, F.lit("too_few")).when(count > high, F.lit("too_many"))
                  .when(~fits, F.lit("text_differs")).otherwise(F.lit("ok")))
        checks.append(F.struct(F.lit(field).alias("field"), count.alias("match_count"),
                               reason.alias("reason")))
    return (pages.select("page_id", F.inline(F.array(*checks)))
            .withColumn("is_valid", F.col("reason") == "ok"))
