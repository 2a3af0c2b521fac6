"""Fixed values of the price-index method.

Everything in this module is a published parameter of the method (basket, weights,
thresholds, status vocabulary, carrier table).  Results only agree with the method
when these values are used as they stand, so they are kept together and never computed.
"""

# --- fixed values: basket, horizons and weights -------------------------------------
BASKET = ["DEL-BOM", "DEL-BLR", "BOM-BLR", "DEL-CCU", "BLR-HYD", "MAA-DEL"]
HORIZONS = [1, 7, 15, 30, 45]
EXPECTED_COMBINATIONS = 30

WEIGHTS_V1 = {
    "DEL-BOM": 0.25, "DEL-BLR": 0.20, "BOM-BLR": 0.18,
    "DEL-CCU": 0.12, "BLR-HYD": 0.10, "MAA-DEL": 0.15,
}
WEIGHTS_V2 = {
    "DEL-BOM": 0.25, "DEL-BLR": 0.20, "BOM-BLR": 0.15,
    "DEL-CCU": 0.10, "BLR-HYD": 0.10, "MAA-DEL": 0.10,
}

# --- fixed values: status vocabulary (raw text -> canonical) ------------------------
STATUS_MAP = {
    "ok": "ok",
    "OK": "ok",
    "no_flights": "no_flights",
    "NO_FLIGHTS": "no_flights",
    "no_flights_or_timeout": "no_flights",
    "NO_CARDS_FOUND": "no_flights",
    "no_cards_found": "no_flights",
    "none": "no_flights",
    "sold_out": "sold_out",
    "SOLD_OUT": "sold_out",
    "unavailable": "sold_out",
    "parse_error": "parse_error",
    "PARSE_ERROR": "parse_error",
    "error": "technical_error",
    "ERROR": "technical_error",
    "scrape_error": "technical_error",
    "SCRAPE_ERROR": "technical_error",
    "BLOCKED": "technical_error",
    "blocked": "technical_error",
    "timeout": "technical_error",
}

# --- fixed values: text tokens ------------------------------------------------------
NULL_TOKENS = ["", "none", "null", "nan", "nat"]
MISSING_TOKENS = ["", "none", "nan"]
CSV_MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                      "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                      "nan", "null"]
TRUE_TOKENS = ["true", "1", "t", "yes"]
FALSE_TOKENS = ["false", "0", "f", "no", "", "none", "null", "nan"]

# --- fixed values: sources and carriers ---------------------------------------------
SOURCE_PREFIXES = [  # file-name prefix -> scraper id, first match wins
    ("indigo", "indigo"), ("air_india", "air_india"), ("spicejet", "spicejet"),
    ("akasa", "akasa"), ("makemytrip", "makemytrip"), ("mmt", "makemytrip"),
    ("goibibo", "goibibo"),
]
OTA_MARKERS = ["makemytrip", "goibibo"]
SOURCE_NAMES = [  # scraper id substring -> display name, first match wins
    ("indigo", "IndiGo"), ("air_india", "Air India"), ("spicejet", "SpiceJet"),
    ("akasa", "Akasa Air"), ("makemytrip", "MakeMyTrip"), ("mmt", "MakeMyTrip"),
    ("goibibo", "Goibibo"),
]
KNOWN_SCRAPERS = ["indigo", "air_india", "spicejet", "akasa", "makemytrip", "goibibo"]
CARRIERS = {
    "6E": "IndiGo", "AI": "Air India", "IX": "Air India Express",
    "SG": "SpiceJet", "QP": "Akasa Air",
}
CARRIER_NAME_ORDER = [  # name substring -> carrier code, first match wins
    ("indigo", "6E"), ("air india express", "IX"), ("air india", "AI"),
    ("spicejet", "SG"), ("akasa air", "QP"), ("akasa", "QP"),
]
EXCLUDED_CARRIER = "Air India Express"

# --- fixed values: keys -------------------------------------------------------------
INGEST_KEYS = ["origin", "destination", "flight_num", "travel_date", "capture_run",
               "source_scraper"]
DAILY_KEYS = ["origin", "destination", "carrier_code", "flight_num", "travel_date",
              "advance_purchase_days", "fare_class"]

# --- fixed values: quality and outlier rules ----------------------------------------
PENALTY_MODEL_SOURCED = 0.30
PENALTY_ESTIMATED = 0.15
PENALTY_MISSING_PRICE = 0.50
PENALTY_STALE = 0.20
BONUS_CONFIRMED = 0.10
PENALTY_STATISTICAL = 0.25
STALE_DAYS = 14
CROSS_SOURCE_TOLERANCE = 0.02
FLAG_STATISTICAL = "price_anomaly_statistical"
FLAG_MODEL = "price_anomaly_ml"
MAD_THRESHOLD = 3.5
MAD_FLOOR = 10.0
MAD_MIN_DIFFERENCE = 100.0
MAD_MIN_GROUP = 3
IQR_FACTOR = 1.5
IQR_FLOOR = 500.0
IQR_MIN_GROUP = 4
FALLBACK_HISTORY_MAX = 20000.0
FALLBACK_FACTOR = 10.0
FOREST_MIN_ROWS = 50
FOREST_TREES = 100
FOREST_SUBSAMPLE = 256

# --- fixed values: forecast and product rules ---------------------------------------
FORECAST_MIN_DAYS = 14
FORECAST_DAYS = 7
FORECAST_Z80 = 1.2816
COVERAGE_MIN_ROUTES = 6
COVERAGE_IGNORED = ["error", "parse_error"]
FAILURE_RUN = 5
SIGNAL_BAND = 5.0
VOLATILITY_BANDS = (0.15, 0.30)
MATCH_BAND = (2, 20)
DIRECT_FARE_RANGE = (500, 100000)
AGENT_FARE_MIN = 1000

# --- fixed values: page-field patterns ----------------------------------------------
FIELD_PATTERNS = {
    "total_fare": r"₹[\d,]+|INR\s*[\d,]+",
    "base_fare": r"₹[\d,]+|INR\s*[\d,]+",
    "departure_time": r"\b\d{2}:\d{2}\b",
    "arrival_time": r"\b\d{2}:\d{2}\b",
    "flight_num": r"\b[A-Z0-9]{2}[\s-]?\d{2,4}\b",
    "fare_class": r"(?i)economy|business|value|saver|flexi",
    "fare_card": r".",
    "origin_code": r"\b[A-Z]{3}\b",
    "destination_code": r"\b[A-Z]{3}\b",
    "fare_split_estimated": r"(?i)true|false",
}

# --- fixed values: class names and patterns of the sites' result pages --------------
AIRLINE_CARD_TAG = "ai-pb-flight-card"
AIRLINE_FIELDS = {
    "flight": "ai-pb-flight-id", "time": "ai-pb-departure-time", "price": "ai-pb-price",
    "departure_city": "ai-pb-departure-city-code", "arrival_city": "ai-pb-arrival-city-code",
    "carrier": "ai-pb-operated-by-info",
}
AGENT_CARD = "listingCard|clusterCard|singleFlightGroup|tupleCard"
AGENT_CARD_ID = "^listing-card"
AGENT_FIELDS = {
    "flight": "flightCode|flightNumber|code", "time": "dept-time|depart-time|deptTime",
    "price": "(?i)actual-price|clusterViewPrice|price(?!-)|fare",
    "departure_city": "dept-city|deptCity|fromCity|departureCity",
    "arrival_city": "arr-city|arrCity|toCity|arrivalCity", "carrier": "airlineName|flightName|boldFont",
}
AGENT_CODE = r"\b((?:6E|AI|IX|SG|QP)[\s-]*\d{3,4})\b"
SECOND_AGENT_CARD = "listingCard|clusterCard|singleFlightGroup|tupleCard|flt-card|flight-card"
SECOND_AGENT_FIELDS = {
    **AGENT_FIELDS, "flight": "flightCode|flightNumber|code|flight-no",
    "price": "(?i)actual-price|clusterViewPrice|flt-price|price(?!-)|fare",
    "carrier": "airlineName|flightName|boldFont|airline-name",
}
SECOND_AGENT_CODE = r"\b((?:6E|AI|IX|SG|QP|UK)[\s-]*\d{3,4})\b"
CHIP_LAYOUT = {
    "card": "srp__search-result-list__item", "price": "selected-fare__fare-price",
    "chip": "fare-category-chip", "sold_out": "sold-out", "departure": "details-wrapper__flight-departure",
    "arrival": "details-wrapper__flight-arrival",
}
INLINE_CARD_CLASSES = ("w-full", "flex")
INLINE_SHAPE = r"(QP\d+).*?(\d{2}:\d{2})([A-Z]{3}).*?(\d{2}:\d{2})([A-Z]{3}).*?₹([\d,]+)"
PIECE_TAGS = ("div", "section", "article", "tr", "li")
PIECE_MARKS = (r"\b\d{2}:\d{2}\b", "(?i)[₹]|INR")
