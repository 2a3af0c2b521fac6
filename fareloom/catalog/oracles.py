"""SQL counterparts of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from ..sources.star import BASKET, BASKET_WEIGHTS, BASKET_WEIGHTS_V2
from . import forest_sql

ORACLES = {}
ID = "order_key, line_number, part_key, supp_key, price"


def _weights(table: dict) -> str:
    return ", ".join(f"('{r}', CAST({w} AS DOUBLE))" for r, w in table.items())


def _sum(table: dict, term: str, around: str = "") -> str:
    text = " + ".join(term.format(i=i, w=w) for i, w in enumerate(table.values()))
    return f"({text})" if around else text


def _wide(table: dict) -> str:
    return ", ".join(f"max(CASE WHEN route = '{r}' THEN fare END) AS f{i}"
                     for i, r in enumerate(table))


QUOTES = """
regions AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
base AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line_number, l_partkey AS part_key,
    l_suppkey AS supp_key, l_extendedprice AS price, co.r_name AS origin, so.r_name AS destination,
    co.r_name || '-' || so.r_name AS route, c_mktsegment AS carrier_code,
    substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2)) AS carrier_name,
    substr(c_mktsegment, 1, 2) || ' ' || CAST(l_partkey % 40 AS VARCHAR) AS flight_num,
    strftime(l_shipdate, '%Y-%m-01') AS travel_date,
    CASE WHEN l_linenumber IN (1, 6) THEN 1 WHEN l_linenumber IN (2, 7) THEN 7
      WHEN l_linenumber = 3 THEN 15 WHEN l_linenumber = 4 THEN 30 ELSE 45 END
      AS advance_purchase_days,
    CASE WHEN l_quantity > 45 THEN 'business' ELSE 'economy' END AS fare_class,
    CASE WHEN l_quantity <= 2 THEN 'parse_error'
      WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'sold_out' ELSE 'ok' END AS status,
    l_quantity, o_orderdate AS scraped_ts, strftime(o_orderdate, '%Y-%m-%d') AS capture_day,
    strftime(o_orderdate, '%Y-%m-01') AS scraped_date, 'RUN_' || o_orderstatus AS capture_run,
    CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'ota' ELSE 'airline_direct' END
      AS source,
    o_orderpriority AS source_scraper
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN regions co ON c_nationkey = co.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN regions so ON s_nationkey = so.n_nationkey),
quotes AS (
  SELECT order_key, line_number, part_key, supp_key, price, origin, destination, route,
    carrier_code, carrier_name, flight_num, travel_date, advance_purchase_days, fare_class,
    CASE WHEN status = 'ok' AND l_quantity <> 3 THEN
      CASE WHEN part_key % 97 = 0 THEN price * 6 ELSE price END END AS total_fare,
    part_key % 7 = 0 AS fare_split_estimated, status,
    CASE WHEN status = 'parse_error' THEN CASE WHEN part_key % 2 = 0 THEN 'error' ELSE 'parse_error'
      END ELSE upper(status) END AS raw_status,
    capture_day || CASE WHEN part_key % 7 = 0 THEN 'T20:30:00+00:00' ELSE 'T02:30:00+05:30' END
      AS scraped_at,
    scraped_ts, capture_day, scraped_date, capture_run, source,
    lower(source_scraper) AS source_name,
    source_scraper, 'raw/' || capture_day || '/' || source_scraper || '_raw.csv' AS source_file,
    CASE WHEN part_key % 11 = 0 THEN 'llm_fallback' ELSE 'regex_parser' END AS data_source_method
  FROM base)"""

MAD = QUOTES + """,
mad_median AS (
  SELECT route, carrier_code, advance_purchase_days, count(total_fare) AS n_values,
    median(total_fare) AS median
  FROM quotes WHERE status = 'ok' AND total_fare IS NOT NULL GROUP BY ALL),
mad_groups AS (
  SELECT m.route, m.carrier_code, m.advance_purchase_days, max(m.n_values) AS n_values,
    max(m.median) AS median, median(abs(q.total_fare - m.median)) AS mad
  FROM quotes q JOIN mad_median m USING (route, carrier_code, advance_purchase_days)
  WHERE q.status = 'ok' AND q.total_fare IS NOT NULL GROUP BY 1, 2, 3),
madded AS (
  SELECT q.*, coalesce(q.status = 'ok' AND n_values >= 3
      AND abs(total_fare - median) > 3.5 * greatest(mad, 10) AND abs(total_fare - median) > 100,
      false) AS far
  FROM quotes q LEFT JOIN mad_groups USING (route, carrier_code, advance_purchase_days)),
eligible AS (SELECT * FROM madded WHERE status = 'ok' AND NOT far AND total_fare IS NOT NULL)"""

MEDIANS = MAD + """,
medians AS (
  SELECT scraped_date, route, advance_purchase_days, median(total_fare) AS fare
  FROM eligible GROUP BY ALL),
route_days AS (
  SELECT scraped_date, route, list_sum(list_sort(list(fare))) / count(*) AS fare,
    count(*) AS n_horizons
  FROM medians GROUP BY ALL)"""

INDEX = MEDIANS + f""",
weights(route, weight) AS (VALUES {_weights(BASKET_WEIGHTS)}),
composite AS (
  SELECT scraped_date, round(({_sum(BASKET_WEIGHTS, "coalesce(f{i} * {w}::DOUBLE, 0)")})
    / nullif({_sum(BASKET_WEIGHTS, "CASE WHEN f{i} IS NULL THEN 0 ELSE {w}::DOUBLE END")}, 0), 2)
    AS composite_daily_fare
  FROM (SELECT scraped_date, {_wide(BASKET_WEIGHTS)} FROM route_days GROUP BY 1)),
complete AS (
  SELECT scraped_date, round(count(*) / 30.0::DOUBLE, 4) AS data_completeness FROM medians GROUP BY 1),
daily AS (
  SELECT scraped_date, composite_daily_fare, data_completeness
  FROM complete LEFT JOIN composite USING (scraped_date)),
base_fares AS (
  SELECT route, fare AS base_fare FROM route_days
  WHERE scraped_date = (SELECT min(scraped_date) FROM route_days)),
indexed AS (
  SELECT scraped_date, route, fare, fare / base_fare * 100 AS index
  FROM route_days LEFT JOIN base_fares USING (route)),
index_daily AS (
  SELECT d.scraped_date AS date,
    round(composite_daily_fare / first_value(composite_daily_fare) OVER (ORDER BY d.scraped_date)
      * 100, 2) AS composite_fare_index,
    composite_daily_fare, data_completeness,
    {", ".join(f'"{k}_{r}"' for r in BASKET for k in ("index", "fare"))}
  FROM daily d LEFT JOIN (
    SELECT scraped_date, {", ".join(
        f"max(CASE WHEN route = '{r}' THEN round({k}, 2) END) AS " + f'"{k}_{r}"'
        for r in BASKET for k in ("index", "fare"))}
    FROM indexed GROUP BY 1) w ON w.scraped_date = d.scraped_date),
index_long AS (
  SELECT date, r.route, CASE {" ".join(f"WHEN r.route = '{r}' THEN " + f'"fare_{r}"' for r in BASKET)}
    END AS fare
  FROM index_daily CROSS JOIN weights r)"""

# Quartiles by rank, interpolated between the two neighbours.
QUARTILES = """SELECT {day}origin, destination, advance_purchase_days, max(n) AS n_values,
    max(CASE WHEN place = floor(0.25::DOUBLE * (n - 1)) THEN total_fare END) * (1 - (0.25::DOUBLE
      * (max(n) - 1) - floor(0.25::DOUBLE * (max(n) - 1)))) + max(CASE WHEN place = ceil(
      0.25::DOUBLE * (n - 1)) THEN total_fare END) * (0.25::DOUBLE * (max(n) - 1)
      - floor(0.25::DOUBLE * (max(n) - 1))) AS q1,
    max(CASE WHEN place = floor(0.75::DOUBLE * (n - 1)) THEN total_fare END) * (1 - (0.75::DOUBLE
      * (max(n) - 1) - floor(0.75::DOUBLE * (max(n) - 1)))) + max(CASE WHEN place = ceil(
      0.75::DOUBLE * (n - 1)) THEN total_fare END) * (0.75::DOUBLE * (max(n) - 1)
      - floor(0.75::DOUBLE * (max(n) - 1))) AS q3
  FROM (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (
      PARTITION BY {day}origin, destination, advance_purchase_days) AS n
    FROM {table} WHERE status = 'ok' AND total_fare IS NOT NULL
    WINDOW w AS (PARTITION BY {day}origin, destination, advance_purchase_days ORDER BY total_fare))
  GROUP BY {day}origin, destination, advance_purchase_days"""

IQR = QUOTES + f""",
quartiles AS ({QUARTILES.format(day="", table="quotes")}),
bounds AS (
  SELECT origin, destination, advance_purchase_days,
    CASE WHEN n_values < 4 THEN 500 ELSE least(q1 - 1.5 * (q3 - q1), 500) END::DOUBLE AS lower_bound,
    CASE WHEN n_values < 4 THEN 200000 ELSE q3 + 1.5 * (q3 - q1) END::DOUBLE AS upper_bound
  FROM quartiles),
bounded AS (SELECT * FROM quotes LEFT JOIN bounds USING (origin, destination, advance_purchase_days)),
iqred AS (
  SELECT *, coalesce(status = 'ok' AND (total_fare < lower_bound OR total_fare > upper_bound), false)
    AS outlier_flag FROM bounded),
accepted AS (SELECT * FROM iqred WHERE status = 'ok' AND NOT outlier_flag),
direct AS (SELECT * FROM accepted WHERE source = 'airline_direct'
           AND carrier_name <> 'Air India Express'),
agent AS (SELECT * FROM accepted WHERE source = 'ota'),
hist AS (SELECT origin, destination, max(total_fare) AS max_fare FROM iqred WHERE NOT outlier_flag
         GROUP BY ALL)"""

PAIRS = IQR + """,
pairs AS (
  SELECT origin, destination, flight_num, advance_purchase_days, ota_fare, dir_fare
  FROM (SELECT origin, destination, flight_num, advance_purchase_days,
          median(total_fare) AS ota_fare FROM agent WHERE total_fare IS NOT NULL GROUP BY ALL) a
  JOIN (SELECT origin, destination, flight_num, advance_purchase_days,
          median(total_fare) AS dir_fare FROM direct WHERE total_fare IS NOT NULL GROUP BY ALL) d
  USING (origin, destination, flight_num, advance_purchase_days))"""

DAYS = IQR + f""",
weights2(route, weight) AS (VALUES {_weights(BASKET_WEIGHTS_V2)}),
day_rows AS (
  SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY scraped_date, origin, destination, carrier_code, flight_num, travel_date,
        advance_purchase_days, fare_class
      ORDER BY scraped_ts DESC, order_key, line_number, part_key, supp_key, price,
        total_fare NULLS LAST) AS rn FROM quotes) WHERE rn = 1),
day_quartiles AS ({QUARTILES.format(day="scraped_date, ", table="day_rows")}),
day_bounds AS (
  SELECT q.scraped_date, q.origin, q.destination, q.advance_purchase_days,
    CASE WHEN n_values < 4 THEN 500 ELSE least(q1 - 1.5 * (q3 - q1), 500) END AS lo,
    CASE WHEN n_values < 4 THEN 10 * coalesce(max_fare, 20000) ELSE q3 + 1.5 * (q3 - q1) END AS hi
  FROM day_quartiles q LEFT JOIN hist h USING (origin, destination)),
day_accepted AS (
  SELECT r.* FROM day_rows r LEFT JOIN day_bounds b
    USING (scraped_date, origin, destination, advance_purchase_days)
  WHERE status = 'ok' AND NOT coalesce(total_fare < lo OR total_fare > hi, false)),
day_pairs AS (
  SELECT scraped_date, advance_purchase_days, 100 * (ota_fare - dir_fare) / dir_fare AS premium
  FROM (SELECT scraped_date, origin, destination, flight_num, advance_purchase_days,
          median(total_fare) AS ota_fare FROM day_accepted WHERE source = 'ota' GROUP BY ALL) a
  JOIN (SELECT scraped_date, origin, destination, flight_num, advance_purchase_days,
          median(total_fare) AS dir_fare FROM day_accepted WHERE source = 'airline_direct'
          GROUP BY ALL) d
    USING (scraped_date, origin, destination, flight_num, advance_purchase_days)
  WHERE ota_fare > 0 AND dir_fare > 0),
day_premium AS (
  SELECT scraped_date, advance_purchase_days, avg(premium) AS premium FROM day_pairs GROUP BY ALL),
day_medians AS (
  SELECT scraped_date, route, advance_purchase_days, median(total_fare) AS fare
  FROM day_accepted WHERE source = 'airline_direct' AND total_fare IS NOT NULL GROUP BY ALL),
day_composite AS (
  SELECT scraped_date AS date, advance_purchase_days,
    round(composite, 2) AS composite_score, round(coalesce(premium, 0), 2) AS ota_premium_pct
  FROM (SELECT scraped_date, advance_purchase_days,
      ({_sum(BASKET_WEIGHTS_V2, "coalesce(f{i} * {w}::DOUBLE, 0)")})
      / nullif({_sum(BASKET_WEIGHTS_V2, "CASE WHEN f{i} IS NULL THEN 0 ELSE {w}::DOUBLE END")}, 0)
      AS composite
    FROM (SELECT scraped_date, advance_purchase_days, {_wide(BASKET_WEIGHTS_V2)}
      FROM day_medians GROUP BY 1, 2))
  LEFT JOIN day_premium USING (scraped_date, advance_purchase_days) WHERE composite IS NOT NULL)"""

SCORED = QUOTES + """,
checks AS (
  SELECT o_orderpriority AS site, o_orderstatus AS field,
    max(o_orderdate) - to_days(4 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS verified
  FROM orders GROUP BY o_orderpriority, o_orderstatus),
ages AS (SELECT site, min(verified) AS oldest FROM checks GROUP BY 1),
stale AS (
  SELECT s AS source_scraper,
    coalesce(floor((epoch(TIMESTAMP '2001-08-06') - epoch(oldest)) / 86400) > 14, true) AS is_stale
  FROM (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NEW']) AS s)
  LEFT JOIN ages ON site = s),
offers AS (
  SELECT DISTINCT flight_num, travel_date, scraped_date, source_scraper, total_fare FROM quotes
  WHERE status = 'ok' AND total_fare IS NOT NULL AND flight_num NOT IN ('unknown', 'error')
    AND total_fare <> 0),
confirmed AS (
  SELECT DISTINCT a.flight_num, a.travel_date, a.scraped_date
  FROM offers a JOIN offers b USING (flight_num, travel_date, scraped_date)
  WHERE a.source_scraper <> b.source_scraper
    AND abs(a.total_fare - b.total_fare) / greatest(a.total_fare, b.total_fare) <= 0.02),
marked AS (
  SELECT q.*, c.flight_num IS NOT NULL AS is_confirmed, coalesce(is_stale, false) AS is_stale
  FROM quotes q LEFT JOIN confirmed c USING (flight_num, travel_date, scraped_date)
  LEFT JOIN stale USING (source_scraper)),
scored AS (
  SELECT *, round(greatest(0, CASE WHEN is_confirmed THEN least(1, penalised + 0.1)
      ELSE penalised END), 4)::DOUBLE AS confidence_score,
    concat_ws(',', CASE WHEN data_source_method = 'llm_fallback' THEN 'llm_sourced' END,
      CASE WHEN fare_split_estimated THEN 'fare_estimated' END,
      CASE WHEN status = 'ok' AND total_fare IS NULL THEN 'missing_price' END,
      CASE WHEN is_stale THEN 'stale_selector' END,
      CASE WHEN is_confirmed THEN 'cross_source_confirmed' END) AS quality_flags
  FROM (SELECT *, 1.0::DOUBLE - CASE WHEN data_source_method = 'llm_fallback' THEN 0.3 ELSE 0 END
      - CASE WHEN fare_split_estimated THEN 0.15 ELSE 0 END
      - CASE WHEN status = 'ok' AND total_fare IS NULL THEN 0.5 ELSE 0 END
      - CASE WHEN is_stale THEN 0.2 ELSE 0 END AS penalised FROM marked))"""

RAW = QUOTES + """,
raw AS (
  SELECT order_key, line_number, part_key, supp_key, price,
    CASE WHEN part_key % 53 <> 0 THEN origin END AS origin, destination, carrier_code, carrier_name,
    flight_num, travel_date,
    CASE WHEN part_key % 31 = 0 THEN NULL ELSE advance_purchase_days END AS horizon,
    CASE WHEN part_key % 5 = 0 THEN ' ' || upper(fare_class) ELSE fare_class END AS fare_class_text,
    fare_class,
    CASE WHEN part_key % 4 = 0 THEN NULL ELSE 0.0::DOUBLE END AS taxes_and_fees,
    part_key % 37 = 0 AS fare_is_bad,
    CASE WHEN part_key % 37 = 0 THEN 'n.a.' WHEN part_key % 13 = 0 THEN 'None'
      WHEN part_key % 17 = 0 THEN '' ELSE ' ' || CAST(CAST(price AS DECIMAL(18, 2)) AS VARCHAR) END
      AS fare_text,
    CASE WHEN part_key % 37 = 0 OR part_key % 13 = 0 OR part_key % 17 = 0 THEN NULL
      ELSE CAST(CAST(price AS DECIMAL(18, 2)) AS DOUBLE) END AS fare,
    CASE WHEN part_key % 41 = 0 THEN NULL WHEN part_key % 6 IN (1, 3) THEN false ELSE true END AS flag,
    CASE WHEN part_key % 43 = 0 THEN NULL WHEN part_key % 8 IN (0, 2) THEN 'technical_error'
      WHEN part_key % 8 = 1 THEN 'no_flights' WHEN part_key % 8 = 3 THEN 'ok'
      WHEN raw_status = 'error' THEN 'technical_error' ELSE lower(raw_status) END AS status,
    scraped_at,
    CASE WHEN part_key % 2 <> 0 THEN source WHEN part_key % 9 = 0 THEN 'ota'
      ELSE 'airline_direct' END AS source,
    CASE WHEN part_key % 3 <> 0 THEN source_name WHEN part_key % 9 = 0 THEN 'Goibibo'
      WHEN part_key % 9 = 1 THEN 'Air India' WHEN part_key % 9 = 2 THEN 'Trip_Finder'
      ELSE 'SpiceJet' END AS source_name,
    CASE WHEN part_key % 9 = 0 THEN 'goibibo' WHEN part_key % 9 = 1 THEN 'air_india'
      WHEN part_key % 9 = 2 THEN 'trip_finder' ELSE 'spicejet' END AS source_scraper, source_file
  FROM quotes),
checked AS (
  SELECT *, concat_ws('; ', CASE WHEN fare_is_bad THEN 'total_fare: not a number' END,
    CASE WHEN flag IS NULL THEN 'fare_split_estimated: not a boolean' END,
    CASE WHEN horizon IS NULL THEN 'advance_purchase_days: not a whole number' END,
    CASE WHEN status IS NULL THEN 'status: unrecognized' END,
    CASE WHEN origin IS NULL THEN 'origin: required' END) AS error FROM raw)"""

SEARCHES = QUOTES + """,
codes AS (
  SELECT *, concat_ws('-', order_key, line_number, part_key, supp_key,
      CAST(CAST(price AS DECIMAL(18, 2)) AS VARCHAR)) AS page_id,
    CASE origin WHEN 'AFRICA' THEN 'AFR' WHEN 'AMERICA' THEN 'AME' WHEN 'ASIA' THEN 'ASI'
      WHEN 'EUROPE' THEN 'EUR' ELSE 'MEA' END AS from_code,
    CASE destination WHEN 'AFRICA' THEN 'AFR' WHEN 'AMERICA' THEN 'AME' WHEN 'ASIA' THEN 'ASI'
      WHEN 'EUROPE' THEN 'EUR' ELSE 'MEA' END AS to_code, floor(price) AS rupees FROM quotes)"""


def oracle(name: str, body: str, ctes: str = "") -> None:
    ORACLES[name] = (f"WITH {ctes.strip()}\n" if ctes else "") + body.strip()


# --- values -------------------------------------------------------------------------

oracle("fare_quotes", "SELECT * EXCLUDE (scraped_ts) FROM quotes", QUOTES)
oracle("route_weight_quotes", f"""
SELECT version, route, weight, n_quotes
FROM (SELECT 'v1' AS version, * FROM (VALUES {_weights(BASKET_WEIGHTS)}) a(route, weight)
  UNION ALL SELECT 'v2', * FROM (VALUES {_weights(BASKET_WEIGHTS_V2)}) b(route, weight))
LEFT JOIN (SELECT route, count(*) AS n_quotes FROM quotes GROUP BY 1) USING (route)""", QUOTES)
oracle("number_parsing", f"SELECT {ID}, fare, fare_is_bad AS is_bad FROM raw", RAW)
oracle("flag_parsing", f"SELECT {ID}, flag FROM raw", RAW)
oracle("fare_classes", f"SELECT {ID}, lower(trim(fare_class_text)) AS fare_class FROM raw", RAW)
oracle("horizon_parsing", f"SELECT {ID}, horizon FROM raw", RAW)
oracle("status_mapping", f"SELECT {ID}, status FROM raw", RAW)
oracle("source_inference", f"SELECT {ID}, source, source_name FROM raw", RAW)
oracle("valid_quotes", """
SELECT origin, destination, flight_num, travel_date, horizon AS advance_purchase_days, fare_class,
  NULL::DOUBLE AS base_fare, taxes_and_fees, fare AS total_fare, flag AS fare_split_estimated,
  status, scraped_at, source, source_name, source_scraper, 'regex_parser' AS data_source_method
FROM checked WHERE error = ''""", RAW)
oracle("rejected_quotes", """
SELECT source_file, error, fare_text AS raw_fare FROM checked WHERE error <> ''""", RAW)
oracle("rejection_reasons", """
SELECT error, count(*) AS n_rows FROM checked WHERE error <> '' GROUP BY 1""", RAW)
oracle("route_names", f"SELECT {ID}, origin || '-' || destination AS route FROM raw", RAW)
oracle("capture_dates", f"""
SELECT {ID}, strftime(CASE WHEN part_key % 7 = 0 THEN scraped_ts
    ELSE scraped_ts - INTERVAL 1 DAY END, '%Y-%m-%d') AS utc_date, capture_day AS text_date
FROM quotes""", QUOTES)
oracle("carrier_resolution", f"""
SELECT {ID}, code AS carrier_code,
  CASE code WHEN '6E' THEN 'IndiGo' WHEN 'AI' THEN 'Air India' WHEN 'IX' THEN 'Air India Express'
    WHEN 'SG' THEN 'SpiceJet' WHEN 'QP' THEN 'Akasa Air'
    ELSE coalesce(nullif(name, ''), 'Unknown Airline') END AS carrier_name
FROM (SELECT *, CASE WHEN p IN ('6E', 'AI', 'IX', 'SG', 'QP') THEN p
    WHEN lower(name) LIKE '%indigo%' THEN '6E' WHEN lower(name) LIKE '%air india express%' THEN 'IX'
    WHEN lower(name) LIKE '%air india%' THEN 'AI' WHEN lower(name) LIKE '%spicejet%' THEN 'SG'
    WHEN lower(name) LIKE '%akasa%' THEN 'QP' ELSE 'UNKNOWN' END AS code
  FROM (SELECT *, (['6E', 'AI', 'IX', 'SG', 'QP', 'ZZ', 'K'])[CAST(part_key % 7 + 1 AS INTEGER)] AS p,
      (['IndiGo Airlines', 'Air India Express', 'air india', 'SpiceJet', 'Akasa', 'Vistara',
        ''])[CAST(supp_key % 7 + 1 AS INTEGER)] AS name FROM quotes))""", QUOTES)
oracle("fare_split_estimates", f"""
SELECT {ID}, base_fare, round(price - base_fare, 2) AS taxes_and_fees FROM (
  SELECT *, greatest(0.0::DOUBLE, round_even((price - 386) / 1.05::DOUBLE - 125, 0)) AS base_fare
  FROM quotes)""", QUOTES)
oracle("travel_weekdays", f"""
SELECT {ID}, CAST(isodow(CAST(travel_date AS DATE)) - 1 AS INTEGER) AS day_of_week
FROM quotes""", QUOTES)
oracle("rupee_texts", f"SELECT {ID}, CAST(floor(price) AS DOUBLE) AS amount FROM quotes", QUOTES)
oracle("export_cleaning", f"""
SELECT {ID}, total_fare, CASE WHEN status = 'ok' THEN 'ok' ELSE '' END AS status
FROM quotes""", QUOTES)
oracle("chip_classes", f"""
SELECT {ID}, CASE WHEN part_key % 5 IN (0, 1) THEN 'business' ELSE 'economy' END AS fare_class,
  part_key % 5 = 2 AS sold_out FROM quotes""", QUOTES)

# --- filters ------------------------------------------------------------------------

oracle("index_eligible", f"SELECT {ID}, route, total_fare FROM eligible", MAD)
oracle("excluded_fare_audit", f"""
SELECT {ID}, status, concat_ws('; ',
    CASE WHEN status <> 'ok' THEN 'status_not_ok (' || status || ')' END,
    CASE WHEN far THEN 'price_anomaly_statistical' END,
    CASE WHEN total_fare IS NULL THEN 'null_total_fare' END) AS exclusion_reason
FROM madded WHERE status <> 'ok' OR far OR total_fare IS NULL""", MAD)
oracle("direct_basket", f"SELECT {ID}, total_fare FROM direct", IQR)
oracle("agent_basket", f"SELECT {ID}, total_fare FROM agent", IQR)
oracle("crosscheck_candidates", f"""
SELECT {ID}, total_fare FROM quotes WHERE status = 'ok' AND total_fare IS NOT NULL
  AND flight_num NOT IN ('unknown', 'error')""", QUOTES)
oracle("fares_recent", f"""
SELECT {ID}, scraped_at FROM quotes
WHERE scraped_ts >= (SELECT max(scraped_ts) FROM quotes) - INTERVAL 720 HOUR""", QUOTES)
oracle("fares_of_latest_date", f"""
SELECT {ID}, scraped_date FROM quotes
WHERE scraped_date = (SELECT max(scraped_date) FROM quotes)""", QUOTES)
oracle("rows_with_flag", f"""
SELECT {ID}, quality_flags FROM scored WHERE fare_split_estimated""", SCORED)
oracle("rows_with_any_flag", f"SELECT {ID}, quality_flags FROM scored WHERE quality_flags <> ''", SCORED)
oracle("confident_rows", f"""
SELECT {ID}, confidence_score FROM scored WHERE confidence_score >= 0.8""", SCORED)
oracle("route_carrier_fares", f"""
SELECT {ID}, total_fare FROM quotes WHERE route = 'ASIA-EUROPE' AND carrier_name = 'Machinery'""",
       QUOTES)
oracle("airport_discards", """
SELECT 'Air India' AS source_name, from_code || '-XXX' AS actual_route, 2 * count(*) AS discarded
FROM codes WHERE part_key % 10 = 0 GROUP BY ALL""", SEARCHES)
oracle("plausible_fares", f"""
SELECT {ID}, floor(price) BETWEEN 500 AND 100000 AS direct_ok,
  CASE WHEN price > 1000 THEN 'ok' ELSE 'parse_error' END AS agent_status FROM quotes""", QUOTES)

# --- joins and duplicates -----------------------------------------------------------

oracle("appended_quotes", f"""
SELECT {ID}, flight_num, capture_run FROM quotes q WHERE NOT EXISTS (
  SELECT 1 FROM quotes m WHERE m.capture_day < '2000-01-01' AND m.origin = q.origin
    AND m.destination = q.destination AND m.flight_num = q.flight_num
    AND m.travel_date = q.travel_date AND m.capture_run = q.capture_run
    AND m.source_scraper = q.source_scraper)""", QUOTES)
oracle("iqr_bounds", """
SELECT origin, destination, advance_purchase_days, round(lower_bound, 4) AS lower_bound,
  round(upper_bound, 4) AS upper_bound FROM bounds""", IQR)
oracle("quotes_with_bounds", f"""
SELECT {ID}, round(lower_bound, 4) AS lower_bound, round(upper_bound, 4) AS upper_bound
FROM bounded""", IQR)
oracle("group_features", f"""
SELECT {ID}, round(grp_mean, 2) AS grp_mean, round(grp_std, 2) AS grp_std
FROM quotes LEFT JOIN (
  SELECT route, carrier_code, advance_purchase_days, avg(total_fare) AS grp_mean,
    coalesce(stddev_samp(total_fare), 0) AS grp_std
  FROM quotes WHERE status = 'ok' AND total_fare IS NOT NULL GROUP BY ALL)
USING (route, carrier_code, advance_purchase_days)""", QUOTES)
oracle("confirmed_keys", "SELECT * FROM confirmed", SCORED)
oracle("confirmed_quotes", f"SELECT {ID}, is_confirmed AS cross_source_confirmed FROM marked", SCORED)
oracle("history_maximum", "SELECT * FROM hist", IQR)
oracle("route_index", """
SELECT scraped_date, route, round(fare, 2) AS fare, round(index, 2) AS index FROM indexed""", INDEX)
oracle("coverage_gaps", """
SELECT scraped_date, source_scraper, h AS advance_purchase_days
FROM (SELECT DISTINCT scraped_date, source_scraper FROM quotes)
CROSS JOIN (SELECT unnest([1, 7, 15, 30, 45]) AS h)
WHERE (scraped_date, source_scraper, h) NOT IN (
  SELECT (scraped_date, source_scraper, advance_purchase_days) FROM (
    SELECT scraped_date, source_scraper, advance_purchase_days, source_file
    FROM quotes WHERE raw_status NOT IN ('error', 'parse_error')
    GROUP BY ALL HAVING count(DISTINCT route) >= 6))""", QUOTES)
oracle("stale_sources", "SELECT source_scraper, is_stale FROM stale", SCORED)

TRAJECTORY = IQR + """,
ranked AS (
  SELECT route, advance_purchase_days, total_fare,
    row_number() OVER (PARTITION BY route, advance_purchase_days ORDER BY total_fare) - 1 AS place,
    count(*) OVER (PARTITION BY route, advance_purchase_days) AS n
  FROM accepted WHERE total_fare IS NOT NULL),
ranked_all AS (
  SELECT route, total_fare, row_number() OVER (PARTITION BY route ORDER BY total_fare) - 1 AS place,
    count(*) OVER (PARTITION BY route) AS n
  FROM accepted WHERE total_fare IS NOT NULL),
route_median AS (SELECT route, total_fare AS level FROM ranked_all WHERE place = n // 2),
seen AS (
  SELECT route, max(CASE WHEN advance_purchase_days = 1 THEN total_fare END) AS s1,
    max(CASE WHEN advance_purchase_days = 7 THEN total_fare END) AS s7,
    max(CASE WHEN advance_purchase_days = 15 THEN total_fare END) AS s15,
    max(CASE WHEN advance_purchase_days = 30 THEN total_fare END) AS s30,
    max(CASE WHEN advance_purchase_days = 45 THEN total_fare END) AS s45
  FROM ranked WHERE place = n // 2 GROUP BY 1),
filled AS (
  SELECT *, coalesce(s1, round(t7 * 1.2)) AS t1 FROM (
    SELECT *, coalesce(s7, t15) AS t7 FROM (
      SELECT *, coalesce(s15, t30) AS t15 FROM (
        SELECT *, coalesce(s30, t45) AS t30 FROM (
          SELECT *, coalesce(s45, s30, round(level * 0.9)) AS t45
          FROM route_median LEFT JOIN seen USING (route)))))),
trajectory AS (
  SELECT route, 'T+1' AS "window", 1 AS advance_purchase_days, t1 AS value, s1 IS NULL AS is_interpolated
    FROM filled
  UNION ALL SELECT route, 'T+7', 7, t7, s7 IS NULL FROM filled
  UNION ALL SELECT route, 'T+15', 15, t15, s15 IS NULL FROM filled
  UNION ALL SELECT route, 'T+30', 30, t30, s30 IS NULL FROM filled
  UNION ALL SELECT route, 'T+45', 45, t45, s45 IS NULL FROM filled),
baseline AS (
  SELECT route, advance_purchase_days, median(total_fare) AS baseline FROM accepted
  WHERE total_fare IS NOT NULL AND CAST(capture_day AS DATE) > (
    SELECT CAST(max(capture_day) AS DATE) - 30 FROM accepted) GROUP BY ALL)"""

oracle("trajectory_with_baseline", """
SELECT route, "window", value, is_interpolated, round(baseline, 2) AS baseline
FROM trajectory LEFT JOIN baseline USING (route, advance_purchase_days)""", TRAJECTORY)
oracle("latest_quotes", f"""
SELECT {ID}, scraped_at FROM (SELECT *, row_number() OVER (
    PARTITION BY origin, destination, carrier_code, flight_num, travel_date,
      advance_purchase_days, fare_class
    ORDER BY scraped_ts DESC, order_key, line_number, part_key, supp_key, price) AS rn FROM quotes)
WHERE rn = 1""", QUOTES)
oracle("latest_quotes_by_source", f"""
SELECT {ID}, source FROM (SELECT *, row_number() OVER (
    PARTITION BY origin, destination, carrier_code, flight_num, travel_date,
      advance_purchase_days, fare_class, source
    ORDER BY scraped_ts DESC, order_key, line_number, part_key, supp_key, price) AS rn FROM quotes)
WHERE rn = 1""", QUOTES)
oracle("page_duplicates", """
SELECT order_key, flight_num, position, status FROM (
  SELECT *, row_number() OVER (PARTITION BY order_key, flight_num
    ORDER BY status = 'parse_error', CASE WHEN status = 'parse_error' THEN -position ELSE position END)
    AS rn
  FROM (SELECT *, CAST(line_number AS BIGINT) * 1000000000000 + CAST(round(price * 100) AS BIGINT)
      AS position FROM quotes)) WHERE rn = 1""", QUOTES)
oracle("union_of_parts", f"""
SELECT {ID}, CASE WHEN capture_day < '2000-01-01' THEN route END AS route,
  CASE WHEN capture_day >= '2000-01-01' THEN total_fare END AS total_fare FROM quotes""", QUOTES)

# --- aggregations -------------------------------------------------------------------

oracle("horizon_medians", """
SELECT scraped_date, route, advance_purchase_days, round(fare, 2) AS fare FROM medians""", MEDIANS)
oracle("route_day_fares", """
SELECT scraped_date, route, round(fare, 2) AS fare, n_horizons FROM route_days""", MEDIANS)
oracle("data_completeness", "SELECT * FROM complete", INDEX)
oracle("composite_fares", "SELECT scraped_date, composite_daily_fare FROM daily", INDEX)
oracle("composite_fares_unweighted", f"""
SELECT scraped_date, round(({_sum(BASKET_WEIGHTS, "coalesce(f{i}, 0)")}) / nullif(
    {_sum(BASKET_WEIGHTS, "CASE WHEN f{i} IS NULL THEN 0 ELSE 1 END")}, 0), 2)
  AS composite_daily_fare
FROM (SELECT scraped_date, {_wide(BASKET_WEIGHTS)} FROM route_days GROUP BY 1)""", INDEX)
oracle("horizon_composites", f"""
SELECT scraped_date, advance_purchase_days, round(
    ({_sum(BASKET_WEIGHTS_V2, "coalesce(f{i} * {w}::DOUBLE, 0)")})
    / {_sum(BASKET_WEIGHTS_V2, "CASE WHEN f{i} IS NULL THEN 0 ELSE {w}::DOUBLE END", "()")}, 2)
  AS composite
FROM (SELECT scraped_date, advance_purchase_days, {_wide(BASKET_WEIGHTS_V2)}
  FROM (SELECT scraped_date, route, advance_purchase_days, median(total_fare) AS fare FROM direct
    WHERE total_fare IS NOT NULL GROUP BY ALL)
  WHERE route IN (SELECT r FROM (VALUES {_weights(BASKET_WEIGHTS_V2)}) w(r, x)) GROUP BY 1, 2)""", IQR)
oracle("agent_premium", """
SELECT advance_purchase_days, round(avg(100 * (ota_fare - dir_fare) / dir_fare), 2) AS premium
FROM pairs WHERE ota_fare > 0 AND dir_fare > 0 GROUP BY 1""", PAIRS)
oracle("mad_groups", """
SELECT route, carrier_code, advance_purchase_days, n_values, round(median, 4) AS median,
  round(mad, 4) AS mad FROM mad_groups""", MAD)
oracle("completed_horizons", """
SELECT DISTINCT source_scraper, advance_purchase_days FROM (
  SELECT source_scraper, advance_purchase_days, source_file FROM quotes
  WHERE raw_status NOT IN ('error', 'parse_error')
  GROUP BY ALL HAVING count(DISTINCT route) >= 3)""", QUOTES)
oracle("failed_sources", """
SELECT source_scraper, source_file, ok_rows, ok_rows = 0 AS failed FROM (
  SELECT *, row_number() OVER (PARTITION BY source_scraper ORDER BY t DESC, source_file DESC) AS rn
  FROM (SELECT source_scraper, source_file, max(scraped_ts) AS t,
      count(*) FILTER (WHERE status = 'ok') AS ok_rows FROM quotes GROUP BY ALL)) WHERE rn = 1""",
       QUOTES)
oracle("flag_counts", """
SELECT flag, count(*) AS n_rows FROM (SELECT unnest(string_split(quality_flags, ',')) AS flag
  FROM scored WHERE quality_flags <> '') GROUP BY 1""", SCORED)
oracle("score_summary", """
SELECT count(*) AS n_rows, round(avg(confidence_score), 4) AS mean_confidence,
  min(confidence_score) AS min_confidence,
  count(*) FILTER (WHERE confidence_score = 1) AS perfect_rows,
  count(*) FILTER (WHERE quality_flags <> '') AS flagged_rows FROM scored""", SCORED)
oracle("route_trend", """
SELECT route, scraped_date AS date,
  round(fare / first_value(fare) OVER (PARTITION BY route ORDER BY scraped_date) * 100, 1) AS value
FROM (SELECT route, scraped_date, median(total_fare) AS fare FROM quotes
  WHERE total_fare IS NOT NULL GROUP BY ALL)""", QUOTES)
oracle("daily_headline", """
SELECT l.date, round(l.score / b.score * 100, 1) AS value, days_live, l.n AS advance_windows,
  round(l.premium, 2) AS ota_premium_pct
FROM (SELECT date, avg(composite_score) AS score, avg(ota_premium_pct) AS premium, count(*) AS n
    FROM day_composite GROUP BY 1 ORDER BY date DESC LIMIT 1) l,
  (SELECT date, avg(composite_score) AS score FROM day_composite GROUP BY 1 ORDER BY date LIMIT 1) b,
  (SELECT count(DISTINCT date) AS days_live FROM day_composite)""", DAYS)
oracle("provenance_stats", """
SELECT coalesce(route, 'ALL') AS route, count(*) AS samples,
  count(*) FILTER (WHERE status = 'ok') AS ok_rows,
  round(100.0::DOUBLE * count(*) FILTER (WHERE status = 'ok') / count(*), 1) AS success_rate
FROM quotes GROUP BY ROLLUP (route)""", QUOTES)
oracle("route_contribution", f"""
SELECT route, weight, median_fare, round(weighted_fare, 4) AS weighted_fare,
  round(100 * weighted_fare / sum(weighted_fare) OVER (), 1) AS contribution
FROM (SELECT route, coalesce(weight, 0)::DOUBLE AS weight, total_fare AS median_fare,
    total_fare * coalesce(weight, 0)::DOUBLE AS weighted_fare
  FROM (SELECT route, total_fare,
      row_number() OVER (PARTITION BY route ORDER BY total_fare) - 1 AS place,
      count(*) OVER (PARTITION BY route) AS n FROM accepted WHERE total_fare IS NOT NULL)
  LEFT JOIN (VALUES {_weights(BASKET_WEIGHTS_V2)}) w(route, weight) USING (route)
  WHERE place = n // 2)""", IQR)
oracle("lead_time_curve", """
SELECT route, advance_purchase_days, round(avg(total_fare), 0) AS value FROM quotes
WHERE status = 'ok' AND total_fare IS NOT NULL GROUP BY ALL""", QUOTES)
oracle("class_gap", """
SELECT route, count(*) FILTER (WHERE fare_class = 'business') AS business_quotes,
  count(*) FILTER (WHERE fare_class = 'economy') AS economy_quotes,
  CASE WHEN count(*) FILTER (WHERE fare_class = 'business') >= 2
      AND count(*) FILTER (WHERE fare_class = 'economy') >= 1
    THEN round(avg(total_fare) FILTER (WHERE fare_class = 'business')
      / avg(total_fare) FILTER (WHERE fare_class = 'economy'), 1) END AS multiplier
FROM accepted WHERE total_fare IS NOT NULL GROUP BY 1""", IQR)
oracle("selector_ages", "SELECT site, strftime(oldest, '%Y-%m-%d') AS oldest FROM ages", SCORED)
oracle("distinct_carriers", "SELECT DISTINCT carrier_name FROM quotes", QUOTES)
oracle("distinct_routes", "SELECT DISTINCT route FROM quotes", QUOTES)

# --- windows ------------------------------------------------------------------------

oracle("upper_middle_medians", """
SELECT route, advance_purchase_days, n AS n_values, total_fare AS fare FROM (
  SELECT route, advance_purchase_days, total_fare,
    row_number() OVER (PARTITION BY route, advance_purchase_days ORDER BY total_fare) - 1 AS place,
    count(*) OVER (PARTITION BY route, advance_purchase_days) AS n
  FROM quotes WHERE total_fare IS NOT NULL) WHERE place = n // 2""", QUOTES)
oracle("day_over_day", """
SELECT scraped_date, route, round(coalesce(100 * (fare - before) / before, 0), 2) AS pct_change
FROM (SELECT *, coalesce(lag(fare) OVER (PARTITION BY route ORDER BY scraped_date), fare) AS before
  FROM route_days)""", MEDIANS)
oracle("headline_change", """
SELECT date, composite_fare_index,
  round(composite_fare_index - lag(composite_fare_index) OVER (ORDER BY date), 1) AS change
FROM index_daily""", INDEX)
oracle("fare_sample", f"""
SELECT route, sample_place, {ID}, status FROM (
  SELECT *, row_number() OVER (PARTITION BY route ORDER BY grp, rnd, advance_purchase_days,
    carrier_name, scraped_ts DESC, {ID}) AS sample_place
  FROM (
    SELECT *, 0 AS grp, row_number() OVER (PARTITION BY route ORDER BY scraped_ts DESC, {ID}) AS rnd
    FROM iqred WHERE status = 'parse_error' OR outlier_flag QUALIFY rnd = 1
    UNION ALL
    SELECT *, 1, row_number() OVER (PARTITION BY route ORDER BY scraped_ts DESC, {ID}) AS rnd
    FROM iqred WHERE status = 'sold_out' AND NOT outlier_flag QUALIFY rnd = 1
    UNION ALL
    SELECT *, 2, row_number() OVER (PARTITION BY route, carrier_name, advance_purchase_days
      ORDER BY scraped_ts DESC, {ID}) AS rnd
    FROM accepted)) WHERE sample_place <= 8""", IQR)
oracle("failure_runs", """
SELECT user_id, count(*) AS run_length, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS run_start,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS run_end
FROM (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
    - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island
  FROM events)
WHERE event_type = 'error' GROUP BY user_id, island HAVING count(*) >= 3""")
oracle("rebased_route_fares", """
SELECT date, route, CASE WHEN base <> 0 THEN round(coalesce(fare, 0) / base * 100, 1) ELSE 100 END
  AS value
FROM (SELECT *, first_value(fare) OVER (PARTITION BY route ORDER BY date) AS base FROM index_long
  WHERE date IN (SELECT date FROM index_daily ORDER BY date DESC LIMIT 30))""", INDEX)

# --- quality, outliers, models ------------------------------------------------------

oracle("quality_scores", f"SELECT {ID}, confidence_score, quality_flags FROM scored", SCORED)
oracle("forest_features", """
SELECT route, carrier_code, CAST(advance_purchase_days AS DOUBLE) AS advance_days,
  CAST(coalesce(isodow(CAST(travel_date AS DATE)) - 1, 0) AS DOUBLE) AS day_of_week, count(*) AS n_rows,
  round(CAST(sum(CAST(total_fare AS DECIMAL(20, 2))) AS DOUBLE), 2) AS fares
FROM quotes WHERE status = 'ok' AND total_fare IS NOT NULL GROUP BY 1, 2, 3, 4""", QUOTES)
FOREST = QUOTES + forest_sql.scores()
oracle("forest_summary", """
SELECT route, count(*) AS n_rows, count(*) FILTER (quality_flags <> '') AS n_flagged,
  count(*) FILTER (anomaly_score <> 0) AS n_scored, max(anomaly_score) AS highest FROM forest_rows GROUP BY 1""", FOREST)
oracle("forest_flags", f"SELECT {ID}, route, anomaly_score, quality_flags FROM forest_rows", FOREST)
oracle("mad_flags", f"""
SELECT {ID}, CASE WHEN far THEN round(greatest(0, confidence_score - 0.25), 4)
    ELSE confidence_score END AS confidence_score,
  concat_ws(',', nullif(quality_flags, ''), CASE WHEN far THEN 'price_anomaly_statistical' END)
    AS quality_flags
FROM scored""", MAD + SCORED[len(QUOTES):].replace("FROM quotes q LEFT JOIN", "FROM madded q LEFT JOIN"))
oracle("iqr_flags", f"SELECT {ID}, outlier_flag FROM iqred", IQR)

FORECAST = """
fit AS (
  SELECT target, count(DISTINCT ds) AS n, regr_slope(y, t) AS slope, avg(t) AS mt, avg(y) AS my,
    max(d) AS last_day
  FROM (SELECT *, CAST(ds AS DATE) AS d, CAST(CAST(ds AS DATE) - DATE '1970-01-01' AS DOUBLE) AS t
    FROM series WHERE y IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT ds) >= 14),
rest AS (
  SELECT target, d, isodow(d) AS wd, y - (my + slope * (t - mt)) AS r
  FROM (SELECT *, CAST(ds AS DATE) AS d, CAST(CAST(ds AS DATE) - DATE '1970-01-01' AS DOUBLE) AS t
    FROM series WHERE y IS NOT NULL) JOIN fit USING (target)),
season AS (SELECT target, wd, avg(r) AS s FROM rest GROUP BY ALL),
band AS (
  SELECT target, sqrt(avg((r - s) * (r - s))) AS sigma FROM rest JOIN season USING (target, wd)
  GROUP BY 1),
calendar AS (
  SELECT DISTINCT target, d, false AS is_forecast FROM rest
  UNION ALL SELECT target, last_day + CAST(i AS INTEGER), true FROM fit
    CROSS JOIN (SELECT unnest(range(1, 8)) AS i)),
predicted AS (
  SELECT c.target, d, is_forecast, my + slope * (CAST(d - DATE '1970-01-01' AS DOUBLE) - mt)
    + coalesce(s, 0) AS yhat, 1.2816::DOUBLE * sigma AS half
  FROM calendar c JOIN fit USING (target) JOIN band USING (target)
  LEFT JOIN season se ON se.target = c.target AND se.wd = isodow(d)),
forecast AS (
  SELECT strftime(d, '%Y-%m-%d') AS ds, target, round(yhat, 2) AS yhat,
    round(yhat - half, 2) AS yhat_lower, round(yhat + half, 2) AS yhat_upper,
    round(greatest(0, least(1, 1 - 2 * half / greatest(abs(yhat), 1)))
      * (SELECT completeness FROM series ORDER BY ds DESC LIMIT 1), 4) AS forecast_confidence,
    is_forecast
  FROM predicted WHERE (SELECT count(DISTINCT ds) FROM series) >= 14)"""

oracle("event_forecast", "SELECT * FROM forecast", """
means AS (
  SELECT strftime(ts, '%Y-%m-%d') AS ds, event_type AS target, avg(value) AS y
  FROM events GROUP BY ALL),
series AS (
  SELECT ds, target, y, count(*) OVER (PARTITION BY ds) / 5.0::DOUBLE AS completeness
  FROM means),""" + FORECAST)
oracle("index_forecast", "SELECT * FROM forecast", INDEX + """,
series AS (
  SELECT date AS ds, 'index_ASIA-EUROPE' AS target, "index_ASIA-EUROPE" AS y,
    data_completeness AS completeness FROM index_daily),""" + FORECAST)

# --- products -----------------------------------------------------------------------

oracle("fare_index_daily", "SELECT * FROM index_daily", INDEX)
oracle("daily_composite", "SELECT * FROM day_composite", DAYS)
oracle("index_latest", """
SELECT *, (SELECT count(*) FROM index_daily) AS total_days_collected FROM index_daily
ORDER BY date DESC LIMIT 1""", INDEX)
oracle("index_history", """
SELECT date, composite_fare_index, composite_daily_fare, data_completeness,
  'ASIA-EUROPE' AS route, "index_ASIA-EUROPE", "fare_ASIA-EUROPE"
FROM index_daily ORDER BY date DESC LIMIT 30""", INDEX)
oracle("quality_flag_page", f"""
SELECT scraped_date, {ID}, confidence_score, quality_flags FROM scored
WHERE quality_flags LIKE '%stale_selector%' AND confidence_score >= 0.5
ORDER BY scraped_date, {ID} LIMIT 100""", SCORED)

HEATMAP = IQR + f""",
dates AS (SELECT DISTINCT scraped_date FROM accepted ORDER BY 1 DESC LIMIT 2),
day_fares AS (
  SELECT route, scraped_date, median(total_fare) AS fare FROM accepted
  WHERE scraped_date IN (SELECT scraped_date FROM dates) AND total_fare IS NOT NULL GROUP BY ALL),
heat AS (
  SELECT n.route, round(coalesce(100 * (n.fare - coalesce(p.fare, n.fare))
      / nullif(coalesce(p.fare, n.fare), 0), 0), 2) AS pct_change, n.fare AS current_fare,
    coalesce(weight, 0)::DOUBLE AS weight
  FROM (SELECT * FROM day_fares WHERE scraped_date = (SELECT max(scraped_date) FROM dates)) n
  LEFT JOIN (SELECT * FROM day_fares WHERE scraped_date = (SELECT min(scraped_date) FROM dates)) p
    USING (route)
  LEFT JOIN (VALUES {_weights(BASKET_WEIGHTS_V2)}) w(route, weight) ON w.route = n.route)"""

oracle("route_heatmap", "SELECT * FROM heat", HEATMAP)
oracle("route_heatmap_sorted", "SELECT * FROM heat ORDER BY lower(route) DESC NULLS LAST", HEATMAP)
oracle("index_heatmap", """
SELECT route, round(coalesce(100 * (now - coalesce(before, now)) / nullif(coalesce(before, now), 0),
  0), 2) AS pct_change, now AS current_fare
FROM (SELECT route, coalesce(max(CASE WHEN place = 1 THEN fare END), 0) AS now,
    max(CASE WHEN place = 2 THEN fare END) AS before
  FROM (SELECT *, dense_rank() OVER (ORDER BY date DESC) AS place FROM index_long)
  WHERE place <= 2 GROUP BY 1)""", INDEX)
oracle("route_trajectory", "SELECT * FROM trajectory", TRAJECTORY)
oracle("seasonal_baseline", """
SELECT route, advance_purchase_days, round(baseline, 2) AS baseline FROM baseline""", TRAJECTORY)
oracle("book_or_wait", """
SELECT route, value AS current_fare, round(baseline, 2) AS trailing_median,
  round(diff, 1) AS diff_pct,
  CASE WHEN diff <= -5 THEN 'GREEN' WHEN diff >= 5 THEN 'RED' ELSE 'AMBER' END AS signal
FROM (SELECT *, 100 * (value - baseline) / baseline AS diff
  FROM trajectory JOIN baseline USING (route, advance_purchase_days)
  WHERE advance_purchase_days = 15 AND baseline > 0)""", TRAJECTORY)
oracle("route_volatility", """
SELECT scraped_date, route, n_quotes, cv,
  CASE WHEN cv IS NULL THEN 'PENDING' WHEN cv < 0.15 THEN 'STABLE' WHEN cv < 0.3 THEN 'ELEVATED'
    ELSE 'HIGH' END AS band
FROM (SELECT scraped_date, route, count(*) AS n_quotes,
    round(stddev_samp(total_fare) / avg(total_fare), 4) AS cv
  FROM quotes WHERE status = 'ok' AND total_fare IS NOT NULL GROUP BY ALL)""", QUOTES)
oracle("ota_direct_comparison", """
SELECT origin, destination, flight_num, advance_purchase_days, round(dir_fare, 2) AS dir_fare,
  round(ota_fare, 2) AS ota_fare, round(ota_fare - dir_fare, 2) AS delta,
  round(100 * (ota_fare - dir_fare) / dir_fare, 2) AS delta_pct,
  abs(round(100 * (ota_fare - dir_fare) / dir_fare, 4)) > 5 AS differs FROM pairs""", PAIRS)
oracle("intraday_range", """
SELECT scraped_date, route, min(total_fare) AS low, max(total_fare) AS high FROM quotes
WHERE status = 'ok' AND total_fare IS NOT NULL GROUP BY ALL""", QUOTES)
oracle("sold_out_rate", """
SELECT scraped_date, route, count(*) AS n_quotes,
  round(avg(CASE WHEN status = 'sold_out' THEN 1.0::DOUBLE ELSE 0 END), 4) AS sold_out_rate
FROM quotes GROUP BY ALL""", QUOTES)
oracle("index_long", "SELECT * FROM index_long", INDEX)
oracle("index_wide", f"""
SELECT scraped_date, {", ".join(
    f"max(CASE WHEN route = '{r}' THEN round({k}, 2) END) AS " + f'"{k}_{r}"'
    for r in BASKET for k in ("index", "fare"))}
FROM indexed WHERE route IN (SELECT route FROM weights) GROUP BY 1""", INDEX)
oracle("backtest", """
SELECT count(*) AS n_months, round(corr(value, reference_value), 4) AS correlation,
  round(100 * avg(abs(value - reference_value) / abs(reference_value)), 2) AS mape
FROM (SELECT date AS month, composite_daily_fare AS value FROM index_daily)
JOIN (SELECT strftime(o_orderdate, '%Y-%m-01') AS month, avg(o_totalprice) AS reference_value
  FROM orders GROUP BY 1) USING (month)""", INDEX)

# --- pages --------------------------------------------------------------------------

_CLEAN = "html"
for _tag in ("script", "style", "svg", "noscript", "head", "header", "footer"):
    _CLEAN = rf"regexp_replace({_CLEAN}, '<{_tag}\b[^>]*>.*?</{_tag}\s*>', '', 'gis')"
for _tag in ("link", "meta"):
    _CLEAN = rf"regexp_replace({_CLEAN}, '<{_tag}\b[^>]*>', '', 'gis')"
_CLEAN = f"regexp_replace({_CLEAN}, '<!--.*?-->', '', 'gs')"

oracle("clean_pages", f"SELECT page_id, {_CLEAN} AS html FROM pages")
# no page of the test tables shows a price, so none has a card and all stay whole
oracle("compact_pages", f"SELECT page_id, {_CLEAN} AS html FROM pages")
oracle("card_pieces", """
SELECT page_id, '<div class=''c''><div>10:30 to 12:45</div><div>₹' || CAST(page_id % 9000 + 1000 AS VARCHAR)
  || '</div></div>' AS piece FROM pages""")
oracle("chip_cards", """
SELECT page_id, '6E' AS carrier_code, '6E ' || CAST(part_key % 900 + 100 AS VARCHAR) AS flight_num,
  CASE WHEN part_key % 5 IN (0, 2) THEN '' WHEN i = 1 THEN 'business' ELSE 'economy' END AS fare_class,
  '06:05' AS departure_time,
  CASE WHEN part_key % 5 IN (0, 2) THEN NULL WHEN i = 1 THEN 20500 ELSE rupees END::DOUBLE AS total_fare,
  CASE part_key % 5 WHEN 0 THEN 'sold_out' WHEN 2 THEN 'parse_error' ELSE 'ok' END AS status
FROM codes CROSS JOIN (SELECT unnest([0, 1]) AS i)
WHERE part_key % 10 <> 0 AND (i = 0 OR part_key % 5 > 2)""", SEARCHES)
oracle("agent_cards_second", """
SELECT page_id, 'UK ' || CAST(part_key AS VARCHAR) AS flight_num, 'unknown' AS departure_time,
  rupees::DOUBLE AS total_fare,
  CASE WHEN rupees > 1000 THEN 'ok' ELSE 'parse_error' END AS status, 'Goibibo' AS source_name
FROM codes WHERE part_key IS NOT NULL""", SEARCHES)
oracle("direct_cards", """
SELECT page_id, from_code AS origin, to_code AS destination,
  CASE WHEN part_key % 4 = 0 THEN 'IX' ELSE 'AI' END AS carrier_code,
  CASE WHEN part_key % 4 = 0 THEN 'Air India Express' ELSE 'Air India' END AS carrier_name,
  'AI ' || CAST(part_key + i AS VARCHAR) AS flight_num, '07:00' AS departure_time,
  CASE WHEN part_key % 6 <> 0 THEN rupees END AS total_fare,
  CASE WHEN part_key % 6 <> 0 THEN 'ok' ELSE 'parse_error' END AS status
FROM codes CROSS JOIN (SELECT unnest([0, 1]) AS i) WHERE part_key % 10 <> 0""", SEARCHES)
oracle("agent_cards", """
SELECT page_id, 'QP' AS carrier_code, 'Akasa Air' AS carrier_name,
  'QP ' || CAST(part_key AS VARCHAR) AS flight_num, '09:15' AS departure_time,
  CASE WHEN part_key % 2 = 0 AND rupees > 1000 THEN rupees WHEN part_key % 3 = 0 THEN 2000 END
    ::DOUBLE AS total_fare,
  CASE WHEN (part_key % 2 = 0 AND rupees > 1000) OR part_key % 3 = 0 THEN 'ok' ELSE 'parse_error'
    END AS status, 'ota' AS source
FROM codes WHERE part_key IS NOT NULL""", SEARCHES)
oracle("line_offers", """
SELECT page_id, flight_num, departure_time, total_fare, status FROM (
  SELECT page_id, 'SG ' || lpad(CAST(part_key % 900 + 100 AS VARCHAR), 3, '0') AS flight_num,
    '06:10' AS departure_time, CASE WHEN i = 0 THEN rupees ELSE 7800 END::DOUBLE AS total_fare,
    'ok' AS status
  FROM codes CROSS JOIN (SELECT unnest([0, 1]) AS i)
  WHERE part_key % 12 > 2 AND (i = 1 AND rupees <> 7800 OR i = 0 AND rupees BETWEEN 500 AND 100000)
  UNION ALL
  SELECT page_id, 'SG 77', '19:45', 8500, 'ok' FROM codes
  WHERE part_key % 12 > 2 AND part_key % 3 = 0
  UNION ALL
  SELECT page_id, 'unknown', 'unknown', NULL,
    CASE part_key % 12 WHEN 1 THEN 'parse_error' ELSE 'no_flights' END
  FROM codes WHERE part_key % 12 <= 2)""", SEARCHES)
oracle("inline_offers", """
SELECT page_id, 'QP' || CAST(part_key AS VARCHAR) AS flight_num, '06:30' AS departure_time,
  b AS base_fare, rupees - b AS taxes_and_fees, rupees AS total_fare
FROM (SELECT *, greatest(0.0::DOUBLE, round_even((rupees - 386) / 1.05::DOUBLE - 125, 0)) AS b
  FROM codes) WHERE part_key % 10 <> 0 AND part_key % 4 <> 0""", SEARCHES)
oracle("placeholder_quotes", """
SELECT page_id, CASE WHEN found THEN 'QP' || CAST(part_key AS VARCHAR) ELSE 'unknown' END AS flight_num,
  CASE WHEN found THEN '06:30' ELSE 'unknown' END AS departure_time,
  CASE WHEN found THEN rupees END AS total_fare,
  CASE WHEN found THEN 'ok' ELSE 'no_flights_or_timeout' END AS status
FROM (SELECT *, part_key % 10 <> 0 AND part_key % 4 <> 0 AS found FROM codes)""", SEARCHES)
oracle("page_health", r"""
SELECT page_id, field, match_count, reason, reason = 'ok' AS is_valid FROM (
  SELECT page_id, field, len(texts) AS match_count,
    CASE WHEN len(texts) < 2 THEN 'too_few' WHEN len(texts) > 20 THEN 'too_many'
      WHEN NOT regexp_matches(array_to_string(texts, chr(1)), wording) THEN 'text_differs'
      ELSE 'ok' END AS reason
  FROM (
    SELECT page_id, 'fare_card' AS field, '[^\x01]' AS wording,
      regexp_extract_all(regexp_replace(html, '<(/?)(b|i|em|a|span|br)\b[^>]*>', '', 'g'),
        '(?s)<li>(.*?)</li>', 1) AS texts FROM pages
    UNION ALL SELECT page_id, 'origin_code', '\b[A-Z]{3}\b',
      regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) FROM pages
    UNION ALL SELECT page_id, 'total_fare', '₹[0-9,]+|INR\s*[0-9,]+',
      regexp_extract_all(html, '(?s)<b>(.*?)</b>', 1) FROM pages))""")
