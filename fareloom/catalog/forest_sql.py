"""SQL that grows and walks the same isolation forest as ``operators.forest``, one level a step."""

from __future__ import annotations

from .. import constants as C
from ..operators.forest import FEATURES, UNITS

LEVELS = 8  #: a tree of 256 rows is cut that often at most


def chance(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE)"


def mean_depth(n: str) -> str:
    return (f"(CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (ln({n} - 1.0::DOUBLE)"
            f" + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * ({n} - 1.0::DOUBLE) / {n} END)")


def _value() -> str:
    cases = " ".join(f"WHEN '{name}' THEN {name}" for name in FEATURES)
    return f"(CASE col {cases} ELSE CASE WHEN carrier_code = substr(col, 2) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END)"


def scores(seed: int = 42, trees: int = C.FOREST_TREES, subsample: int = C.FOREST_SUBSAMPLE,
           least: int = C.FOREST_MIN_ROWS) -> str:
    """Named tables after ``quotes``; the last, ``forest_rows``, has every quote with score and flag."""
    features = ", ".join(FEATURES)
    tables = [f"""
forest_sums AS (
  SELECT route, carrier_code, advance_purchase_days, count(*)::HUGEINT AS n, sum(u)::HUGEINT AS s, sum(u * u)::HUGEINT AS q
  FROM (SELECT *, CAST(round(total_fare * {UNITS}) AS BIGINT)::HUGEINT AS u FROM quotes
    WHERE status = 'ok' AND total_fare IS NOT NULL) GROUP BY ALL),
forest_groups AS (
  SELECT route, carrier_code, advance_purchase_days,
    round(s::DOUBLE / n::DOUBLE / {UNITS} * 1000000) / 1000000 AS grp_mean,
    round(CASE WHEN n > 1 THEN sqrt((n * q - s * s)::DOUBLE / (n::DOUBLE * (n::DOUBLE - 1))) / {UNITS} ELSE 0.0::DOUBLE END
      * 1000000) / 1000000 AS grp_std FROM forest_sums),
points AS MATERIALIZED (
  SELECT *, row_number() OVER () AS pid FROM (
    SELECT route, carrier_code, advance_purchase_days::DOUBLE AS advance_days,
      coalesce(isodow(TRY_CAST(travel_date AS DATE)) - 1, 0)::DOUBLE AS day_of_week, total_fare AS fare, grp_mean, grp_std,
      count(*) AS copies
    FROM quotes JOIN forest_groups USING (route, carrier_code, advance_purchase_days)
    WHERE status = 'ok' AND total_fare IS NOT NULL GROUP BY ALL)),
sizes AS MATERIALIZED (SELECT route, sum(copies)::BIGINT AS route_rows FROM points GROUP BY 1 HAVING sum(copies) >= {least}),
entrants AS (
  SELECT *, concat_ws('|', route, carrier_code, CAST(advance_days AS INTEGER), CAST(day_of_week AS INTEGER),
    CAST(round(fare * {UNITS}) AS BIGINT), copy) AS name
  FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM points JOIN sizes USING (route))),
entered AS (
  SELECT *, CAST(floor({float(trees)}::DOUBLE * least(1.0::DOUBLE, {float(subsample)}::DOUBLE / route_rows)
      + {chance(f"'{seed}|row|' || name")}) AS INTEGER) AS many,
    CAST(floor({chance(f"'{seed}|start|' || name")} * {trees}) AS INTEGER) AS first_tree FROM entrants),
level0 AS MATERIALIZED (
  SELECT route, (first_tree + unnest(range(0, least(many, {trees})))) % {trees} AS tree, 1::BIGINT AS node, carrier_code, {features},
    CAST(ceil(log2(greatest(least({subsample}, route_rows), 2))) AS INTEGER) AS deepest
  FROM entered WHERE many > 0),
walk0 AS MATERIALIZED (
  SELECT pid, route, tree, 1::BIGINT AS node, carrier_code, {features}
  FROM points JOIN (SELECT DISTINCT route, tree FROM level0) USING (route))"""]
    for d in range(LEVELS + 1):
        opened = ", ".join(f"CASE WHEN min({c}) < max({c}) THEN [{{'c': '{c}', 'lo': min({c}), 'hi': max({c})}}] ELSE [] END"
                           for c in FEATURES)
        name = "route || '|' || tree || '|' || node"
        tables.append(f"""
nodes{d} AS MATERIALIZED (
  SELECT route, tree, node, pick.c AS col, CASE WHEN pick.c[1] = '=' THEN 0.0::DOUBLE ELSE
      pick.lo + (pick.hi - pick.lo) * {chance(f"'{seed}|cut|' || {name}")} END AS cut, {d} + {mean_depth("n")} AS depth
  FROM (SELECT *, CASE WHEN n >= 2 AND len(opened) > 0 AND {d} < deepest
      THEN opened[CAST(floor({chance(f"'{seed}|column|' || {name}")} * len(opened)) AS INTEGER) + 1] END AS pick
    FROM (SELECT route, tree, node, count(*) AS n, any_value(deepest) AS deepest, flatten([{opened},
        CASE WHEN count(DISTINCT carrier_code) > 1 THEN list_transform(list_sort(list(DISTINCT carrier_code)),
          lambda x: {{'c': '=' || x, 'lo': 0.0::DOUBLE, 'hi': 1.0::DOUBLE}}) ELSE [] END]) AS opened
      FROM level{d} GROUP BY 1, 2, 3))),
leaves{d} AS (SELECT pid, depth FROM walk{d} JOIN nodes{d} USING (route, tree, node) WHERE col IS NULL)""")
        if d < LEVELS:
            step = f"2 * node + CASE WHEN {_value()} > cut THEN 1 ELSE 0 END AS node, carrier_code, {features}"
            tables.append(f"""
level{d + 1} AS MATERIALIZED (
  SELECT route, tree, {step}, deepest FROM level{d} JOIN nodes{d} USING (route, tree, node) WHERE col IS NOT NULL),
walk{d + 1} AS MATERIALIZED (
  SELECT pid, route, tree, {step} FROM walk{d} JOIN nodes{d} USING (route, tree, node) WHERE col IS NOT NULL)""")
    ended = " UNION ALL ".join(f"SELECT * FROM leaves{d}" for d in range(LEVELS + 1))
    tables.append(f"""
totals AS (SELECT pid, sum(depth) AS total FROM ({ended}) GROUP BY 1),
grown AS (SELECT route, count(*) AS n_trees FROM nodes0 GROUP BY 1),
point_scores AS (
  SELECT points.*, pow(2.0::DOUBLE, -(total / n_trees) / {mean_depth(f"least({subsample}, route_rows)")}) AS raw
  FROM points JOIN totals USING (pid) JOIN grown USING (route) JOIN sizes USING (route)),
forest_rows AS (
  SELECT q.*, coalesce(round(raw - 0.5, 4), 0) AS anomaly_score,
    CASE WHEN raw > 0.5 THEN '{C.FLAG_MODEL}' ELSE '' END AS quality_flags
  FROM quotes q LEFT JOIN point_scores p ON q.status = 'ok' AND q.total_fare = p.fare AND q.route = p.route
    AND q.carrier_code = p.carrier_code AND q.advance_purchase_days = p.advance_days
    AND coalesce(isodow(TRY_CAST(q.travel_date AS DATE)) - 1, 0) = p.day_of_week)""")
    return "," + ",".join(tables)
