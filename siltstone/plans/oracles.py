"""What DuckDB runs for each registered query.

Written out by hand: rules, guards, descriptions and the facts don't come from the objects that the Spark side is
built of, so that a fault there shows.
"""

from __future__ import annotations

TRADE = """
WITH line AS (
  SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS raw_id, l_linenumber AS n,
         o_orderdate AS pickup_ts, l_shipdate AS dropoff_ts,
         CAST(date_diff('day', o_orderdate, l_shipdate) AS DECIMAL(18,2)) AS minutes,
         CAST(l_quantity AS DECIMAL(10,2)) AS distance,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS fare,
         CAST(l_discount AS DECIMAL(4,2)) AS discount, CAST(l_tax AS DECIMAL(4,2)) AS tax,
         l_returnflag, o_orderpriority,
         cr.r_name AS pu_borough, cn.n_name AS pu_zone, sr.r_name AS do_borough, sn.n_name AS do_zone
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN region cr ON cn.n_regionkey = cr.r_regionkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN region sr ON sn.n_regionkey = sr.r_regionkey),
priced AS (SELECT *, CAST(fare * discount AS DECIMAL(12,2)) AS tip FROM line),
t AS (
  SELECT raw_id, pickup_ts, dropoff_ts, minutes, distance, fare, tip,
         CAST(fare * (1 - discount) * (1 + tax) AS DECIMAL(12,2)) AS total,
         CAST(-2 * tip AS DECIMAL(12,2)) AS extra, CAST(fare * tax AS DECIMAL(12,2)) AS mta_tax,
         CAST(0 AS DECIMAL(12,2)) AS tolls, CAST(0 AS DECIMAL(12,2)) AS improvement,
         CASE WHEN n = 3 THEN NULL ELSE CAST(0 AS DECIMAL(12,2)) END AS congestion,
         n - 1 AS passengers,
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS rate_code,
         CAST(substr(o_orderpriority, 1, 1) AS INT) AS payment_type,
         pu_borough, pu_zone, do_borough, do_zone,
         CASE WHEN minutes > 0 THEN CAST(distance AS DOUBLE) / CAST(minutes AS DOUBLE) END AS mph,
         CASE WHEN fare > 0 THEN 100 * CAST(tip AS DOUBLE) / CAST(fare AS DOUBLE) END AS tip_pct,
         CAST(pickup_ts AS DATE) AS pickup_date, CAST(month(pickup_ts) AS INT) AS month,
         CAST(dayofweek(pickup_ts) + 1 AS INT) AS dow, CAST(hour(pickup_ts) AS INT) AS hour
  FROM priced),
f AS (
  SELECT *,
         CASE WHEN distance IS NULL OR distance <= 0 THEN 1 ELSE 0 END AS q_non_positive_distance,
         CASE WHEN minutes IS NULL OR minutes <= 0 THEN 1 ELSE 0 END AS q_non_positive_duration,
         CASE WHEN minutes > 0 AND minutes < 10 AND distance > 0 THEN 1 ELSE 0 END AS q_implausibly_short,
         CASE WHEN minutes > 1800 THEN 1 ELSE 0 END AS q_excessive_duration,
         CASE WHEN distance > 48 THEN 1 ELSE 0 END AS q_excessive_distance,
         CASE WHEN fare < 0 OR total < 0 THEN 1 ELSE 0 END AS q_negative_amount,
         CASE WHEN fare > 95000 THEN 1 ELSE 0 END AS q_excessive_fare,
         CASE WHEN mph > 4 THEN 1 ELSE 0 END AS q_implausible_speed,
         CASE WHEN distance > 0 AND minutes > 0 AND mph < 0.004 THEN 1 ELSE 0 END AS q_stalled_trip,
         CASE WHEN abs(total - (coalesce(fare, 0) + coalesce(extra, 0) + coalesce(mta_tax, 0) + coalesce(tip, 0)
                   + coalesce(tolls, 0) + coalesce(improvement, 0) + coalesce(congestion, 0))) > 100
              THEN 1 ELSE 0 END AS q_total_mismatch,
         CASE WHEN fare > 0 AND tip > 0.095 * fare THEN 1 ELSE 0 END AS q_disproportionate_tip,
         CASE WHEN pickup_ts IS NULL OR pickup_ts < TIMESTAMP '1993-01-01' OR pickup_ts >= TIMESTAMP '1998-01-01'
              THEN 1 ELSE 0 END AS q_outside_period,
         CASE WHEN coalesce(pu_borough, 'N/A') IN ('Unknown', 'N/A') OR coalesce(do_borough, 'N/A') IN ('Unknown', 'N/A')
              THEN 1 ELSE 0 END AS q_unknown_zone,
         CASE WHEN passengers IS NULL OR passengers = 0 THEN 1 ELSE 0 END AS q_missing_passengers
  FROM t),
"""
_ISSUES = """
g AS (
  SELECT *, q_non_positive_distance + q_non_positive_duration + q_implausibly_short + q_excessive_duration
       + q_excessive_distance + q_negative_amount + q_excessive_fare + q_implausible_speed + q_stalled_trip
       + q_total_mismatch + q_disproportionate_tip + q_outside_period + q_unknown_zone + q_missing_passengers AS issue_count
  FROM f)
"""
TRADE += _ISSUES
EVENTS = (
    """
WITH t AS (
  SELECT CAST(1 AS DECIMAL(18,2)) AS minutes, CAST(1 AS DECIMAL(10,2)) AS distance, CAST(value AS DECIMAL(12,2)) AS fare,
         ts AS pickup_ts, CAST(1 AS DOUBLE) AS mph, CAST(dayofweek(ts) + 1 AS INT) AS dow, CAST(hour(ts) AS INT) AS hour
  FROM events),
f AS (
  SELECT *, 0 AS q_non_positive_distance, 0 AS q_non_positive_duration, 0 AS q_implausibly_short, 0 AS q_excessive_duration,
         0 AS q_excessive_distance, CASE WHEN fare < 0 THEN 1 ELSE 0 END AS q_negative_amount,
         CASE WHEN fare > 90 THEN 1 ELSE 0 END AS q_excessive_fare, 0 AS q_implausible_speed, 0 AS q_stalled_trip,
         0 AS q_total_mismatch, 0 AS q_disproportionate_tip,
         CASE WHEN pickup_ts IS NULL OR pickup_ts < TIMESTAMP '2024-01-02' OR pickup_ts >= TIMESTAMP '2024-01-29'
              THEN 1 ELSE 0 END AS q_outside_period, 0 AS q_unknown_zone, 0 AS q_missing_passengers
  FROM t),
"""
    + _ISSUES
)
#: The conditions under which a row can bear a measure.
USABLE = {
    "trip_count": "q_negative_amount = 0",
    "location": "q_unknown_zone = 0",
    "time": "q_non_positive_duration + q_outside_period = 0",
    "distance": "q_non_positive_distance + q_implausibly_short + q_excessive_distance + q_implausible_speed = 0",
    "duration": "q_non_positive_duration + q_implausibly_short + q_excessive_duration + q_implausible_speed + q_stalled_trip = 0",
    "speed": "q_non_positive_distance + q_non_positive_duration + q_implausibly_short + q_excessive_duration"
    " + q_excessive_distance + q_implausible_speed + q_stalled_trip = 0",
    "fare": "q_negative_amount + q_excessive_fare = 0",
    "tip": "q_negative_amount + q_disproportionate_tip = 0",
    "total": "q_negative_amount + q_excessive_fare + q_disproportionate_tip = 0",
    "fee_breakdown": "q_negative_amount + q_total_mismatch = 0",
    "passengers": "q_missing_passengers = 0",
}
MEANINGS = {
    "trip_count": ("that the row is one trip", 1),
    "location": ("where it began and ended", 1),
    "time": ("when it began", 2),
    "distance": ("how far it went", 4),
    "duration": ("how long it took", 5),
    "speed": ("distance over duration", 7),
    "fare": ("the fare, and shares of it", 2),
    "tip": ("the tip", 2),
    "total": ("the total and the revenue", 3),
    "fee_breakdown": ("the single fees", 2),
    "passengers": ("how many people rode", 1),
}
#: Rule: severity, description, what it invalidates, and the cells that show why it fired.
RULES = {
    "non_positive_distance": ("error", "No distance, or none above zero", "distance, speed", "'distance'"),
    "non_positive_duration": ("error", "Ends no later than it begins", "duration, speed, time", "'minutes'"),
    "implausibly_short": ("warn", "Went some way in under 10 minutes", "distance, duration, speed", "'minutes'"),
    "excessive_duration": ("error", "Took over 1800 minutes", "duration, speed", "'minutes'"),
    "excessive_distance": ("error", "Went over 48 miles", "distance, speed", "'distance'"),
    "negative_amount": ("error", "A negative fare or total", "trip_count, fare, tip, total, fee_breakdown", "concat_ws('+', CASE WHEN fare < 0 THEN 'fare' END, CASE WHEN total < 0 THEN 'total' END)"),
    "excessive_fare": ("warn", "A fare over 95000", "fare, total", "'fare'"),
    "implausible_speed": ("error", "Faster than 4 mph", "distance, duration, speed", "'mph'"),
    "stalled_trip": ("warn", "Slower than 0.004 mph", "duration, speed", "'mph'"),
    "total_mismatch": ("warn", "The parts differ from the total by over 100", "fee_breakdown", "'total'"),
    "disproportionate_tip": ("warn", "A tip over 0.095 times the fare", "tip, total", "'tip'"),
    "outside_period": ("error", "Begins outside 1993-01-01 00:00:00 to 1998-01-01 00:00:00", "time", "'pickup_ts'"),
    "unknown_zone": ("warn", "An end at no known zone", "location", "concat_ws('+', CASE WHEN pu_borough IN ('Unknown', 'N/A') THEN 'pu_zone' END, CASE WHEN do_borough IN ('Unknown', 'N/A') THEN 'do_zone' END)"),
    "missing_passengers": ("warn", "No number of passengers, or zero", "passengers", "'passengers'"),
}
DAY = """CASE dow WHEN 1 THEN 'Sunday' WHEN 2 THEN 'Monday' WHEN 3 THEN 'Tuesday' WHEN 4 THEN 'Wednesday'
         WHEN 5 THEN 'Thursday' WHEN 6 THEN 'Friday' ELSE 'Saturday' END"""
PAYMENT = """CASE payment_type WHEN 1 THEN 'Credit card' WHEN 2 THEN 'Cash' WHEN 3 THEN 'No charge' WHEN 4 THEN 'Dispute'
             WHEN 5 THEN 'Unknown' WHEN 6 THEN 'Voided trip' ELSE 'Other' END"""
DISCREPANCY = "total - (fare + extra + mta_tax + tip + tolls + improvement + coalesce(congestion, 0))"


def _if(*measures: str) -> str:
    return " AND ".join(USABLE[m] for m in measures)


def _mean(x: str, places: int, condition: str = "TRUE") -> str:
    """Rounded as a decimal, so that a half goes away from zero, as Spark has it for doubles."""
    x = f"CASE WHEN {condition} THEN {x} END"
    return f"CAST(ROUND(CAST(CAST(SUM({x}) AS DOUBLE) / NULLIF(COUNT({x}), 0) AS DECIMAL(38,10)), {places}) AS DOUBLE)"


def _workflows(valid: bool) -> dict[str, str]:
    """``valid``: with populations and guards; otherwise over all rows."""
    g = _if if valid else lambda *_: "TRUE"
    place, when = g("trip_count", "location"), g("trip_count", "time")
    miles, minutes = f"{_mean('distance', 2, g('distance'))} AS avg_miles", f"{_mean('minutes', 1, g('duration'))} AS avg_minutes"
    fare, tip = f"{_mean('fare', 2, g('fare'))} AS avg_fare", f"{_mean('tip_pct', 1, g('tip', 'fare'))} AS avg_tip_pct"
    total = f"{_mean('total', 2, g('total'))} AS avg_total"
    revenue = f"ROUND(CAST(SUM(CASE WHEN {g('total')} THEN total END) AS DOUBLE), 0) AS revenue"
    hours = ", ".join(f"COUNT(*) FILTER (WHERE hour = {h}) AS h{h:02d}" for h in range(24))
    ratio = "CAST(SUM(fare) AS DOUBLE) / CAST(SUM(distance) AS DOUBLE)"

    def busiest(end: str) -> str:
        return f"""{TRADE} SELECT {end}_borough AS borough, {end}_zone AS zone, COUNT(*) AS trips, {miles}, {minutes}, {fare}, {tip}
                   FROM g WHERE {place} GROUP BY 1, 2 ORDER BY trips DESC, borough, zone LIMIT 15"""

    def pairs(condition: str) -> str:
        return f"""{TRADE} SELECT pu_borough AS from_borough, pu_zone AS from_zone, do_borough AS to_borough, do_zone AS to_zone,
                          COUNT(*) AS trips, {miles}, {minutes}, {total}
                   FROM g WHERE {place} AND {condition} GROUP BY 1, 2, 3, 4 ORDER BY trips DESC, 1, 2, 3, 4 LIMIT 20"""

    return {
        "busiest_zones_pickup": busiest("pu"),
        "busiest_zones_dropoff": busiest("do"),
        "borough_summary": f"{TRADE} SELECT pu_borough AS borough, COUNT(*) AS trips, {miles}, {fare}, {total}, {tip}, {revenue} FROM g WHERE {place} GROUP BY 1",
        "activity_by_hour": f"{EVENTS} SELECT hour AS pickup_hour, COUNT(*) AS trips, {_mean('mph', 2, g('speed'))} AS avg_mph, {minutes}, {fare} FROM g WHERE {when} GROUP BY 1",
        "activity_by_dow": f"{TRADE} SELECT dow, {DAY} AS day, COUNT(*) AS trips, {miles}, {fare}, {tip} FROM g WHERE {when} GROUP BY dow",
        "activity_by_month": f"""{TRADE} SELECT month AS month_num, monthname(make_date(2000, month, 1)) AS month_name, COUNT(*) AS trips, {miles}, {fare}, {revenue}
                                 FROM g WHERE month IS NOT NULL AND {when} GROUP BY month""",
        "hourly_heatmap": f"{EVENTS} SELECT {DAY} AS day, {hours} FROM g WHERE {when} GROUP BY dow",
        "tipping_by_borough": f"""{TRADE} SELECT pu_borough AS borough, payment_type, {PAYMENT} AS payment, COUNT(*) AS trips, {_mean('tip_pct', 2)} AS avg_tip_pct,
                                         {_mean('tip', 2)} AS avg_tip, {_mean('fare', 2)} AS avg_fare
                                  FROM g WHERE fare > 0 AND {g('trip_count', 'location', 'fare', 'tip')}
                                  GROUP BY pu_borough, payment_type HAVING COUNT(*) >= 500""",
        "fare_per_mile": f"""{TRADE} SELECT pu_borough AS borough, pu_zone AS zone, COUNT(*) AS trips, ROUND({ratio}, 2) AS fare_per_mile, {_mean('distance', 2)} AS avg_miles,
                                    {_mean('fare', 2)} AS avg_fare, {_mean('mph', 1, g('speed'))} AS avg_mph
                             FROM g WHERE distance > 0 AND fare > 0 AND {g('trip_count', 'location', 'fare', 'distance')}
                             GROUP BY 1, 2 HAVING COUNT(*) >= 1000 ORDER BY {ratio} DESC, 1, 2 LIMIT 15""",
        "od_pairs": pairs("TRUE"),
        "od_pairs_cross": pairs("pu_borough <> do_borough"),
    }


def _impact() -> str:
    def line(metric: str, depends_on: str, value) -> str:
        scenarios = {"all_rows": "TRUE", "strict_clean": "issue_count = 0", "selective": _if(*depends_on.split(", "))}
        return f"SELECT '{metric}' AS metric, '{depends_on}' AS depends_on, {', '.join(f'{value(c)} AS {s}' for s, c in scenarios.items())} FROM g"

    lines = [
        line("trips", "trip_count", lambda c: f"CAST(COUNT(*) FILTER (WHERE {c}) AS DOUBLE)"),
        line("avg_miles", "distance", lambda c: _mean("distance", 2, c)),
        line("avg_minutes", "duration", lambda c: _mean("minutes", 1, c)),
        line("avg_mph", "speed", lambda c: _mean("mph", 2, c)),
        line("max_miles", "distance", lambda c: f"ROUND(CAST(MAX(distance) FILTER (WHERE {c}) AS DOUBLE), 2)"),
        line("avg_fare", "fare", lambda c: _mean("fare", 2, c)),
        line("avg_tip_pct", "tip, fare", lambda c: _mean("tip_pct", 2, c)),
    ]
    return TRADE + " UNION ALL ".join(lines)


def _browse(condition: str, more: str = "", fact: str = TRADE) -> str:
    names = ", ".join(f"CASE WHEN q_{r} = 1 THEN '{r}' END" for r in RULES)
    cells = ", ".join(f"CASE WHEN q_{r} = 1 THEN concat('{r}=', {RULES[r][3]}) END" for r in sorted(RULES))
    return f"""{fact} SELECT raw_id, pickup_ts, pu_zone, do_zone, CAST(minutes AS DOUBLE) AS minutes, ROUND(CAST(mph AS DOUBLE), 6) AS mph, issue_count AS issues,
                      coalesce(nullif(concat_ws(', ', {names}), ''), '—') AS flags, concat_ws(';', {cells}) AS tested{more}
               FROM g WHERE {condition} ORDER BY issue_count DESC, pickup_ts, pu_zone, do_zone, raw_id LIMIT 25"""


# The events as a file's lines: the texts, and what becomes of them.
FILE = """
WITH n AS (SELECT n_nationkey AS k, r_name AS borough, n_name AS zone FROM nation JOIN region ON n_regionkey = r_regionkey),
line AS (
  SELECT event_id AS raw_id, user_id, ts, event_id % 101 = 0 OR event_id % 103 = 0 AS malformed,
         CASE WHEN event_id % 97 = 0 THEN '2024-01-01' WHEN event_id % 89 = 0 THEN '99/01/2024 01:00:00 AM'
              WHEN event_id % 83 <> 0 THEN strftime(ts, '%m/%d/%Y %I:%M:%S %p') END AS pickup_text,
         strftime(ts + to_seconds(event_id % 50 * 60 + 5), '%m/%d/%Y %I:%M:%S %p') AS dropoff_text,
         CAST(event_id % 4 AS VARCHAR) AS passengers_text, CAST(event_id % 160 AS VARCHAR) AS distance_text,
         CASE WHEN event_id % 31 = 0 THEN '1,234.50' WHEN event_id % 37 = 0 THEN 'abc'
              WHEN event_id % 41 <> 0 THEN CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END AS money_text,
         CAST(event_id % 10 AS VARCHAR) AS tip_text
  FROM events),
t AS (
  SELECT raw_id, pickup_text, dropoff_text, passengers_text, distance_text, money_text AS fare_text, tip_text, money_text AS total_text,
         date_trunc('second', ts) AS pickup_ts, raw_id % 50 * 60 + 5 AS seconds,
         CAST((raw_id % 50 * 60 + 5) / 60.0 AS DECIMAL(18,2)) AS minutes, CAST(raw_id % 160 AS DECIMAL(10,2)) AS distance,
         CAST(CASE WHEN raw_id % 160 >= 0 THEN raw_id % 160 / ((raw_id % 50 * 60 + 5) / 3600.0) END AS DECIMAL(18,2)) AS mph,
         TRY_CAST(replace(money_text, ',', '') AS DECIMAL(12,2)) AS fare, TRY_CAST(replace(money_text, ',', '') AS DECIMAL(12,2)) AS total,
         CAST(raw_id % 10 AS DECIMAL(12,2)) AS tip, raw_id % 4 AS passengers,
         coalesce(p.borough, 'Unknown') AS pu_borough, coalesce(p.zone, 'Unknown') AS pu_zone,
         coalesce(d.borough, 'Unknown') AS do_borough, coalesce(d.zone, 'Unknown') AS do_zone
  FROM line LEFT JOIN n p ON user_id % 30 = p.k LEFT JOIN n d ON raw_id % 28 = d.k
  WHERE NOT malformed AND pickup_text IS NOT NULL AND pickup_text NOT IN ('2024-01-01', '99/01/2024 01:00:00 AM')),
f AS (
  SELECT *, CASE WHEN distance <= 0 THEN 1 ELSE 0 END AS q_non_positive_distance, 0 AS q_non_positive_duration,
         CASE WHEN minutes < 0.5 AND distance > 0 THEN 1 ELSE 0 END AS q_implausibly_short, 0 AS q_excessive_duration,
         CASE WHEN distance > 150 THEN 1 ELSE 0 END AS q_excessive_distance,
         CASE WHEN fare < 0 THEN 1 ELSE 0 END AS q_negative_amount, CASE WHEN fare > 90 THEN 1 ELSE 0 END AS q_excessive_fare,
         CASE WHEN mph > 500 THEN 1 ELSE 0 END AS q_implausible_speed,
         CASE WHEN distance > 0 AND mph < 0.5 THEN 1 ELSE 0 END AS q_stalled_trip,
         CASE WHEN abs(total - (fare + tip)) > 1 THEN 1 ELSE 0 END AS q_total_mismatch,
         CASE WHEN fare > 0 AND tip > 3 * fare THEN 1 ELSE 0 END AS q_disproportionate_tip,
         CASE WHEN pickup_ts < TIMESTAMP '2024-01-02' OR pickup_ts >= TIMESTAMP '2024-01-29' THEN 1 ELSE 0 END AS q_outside_period,
         CASE WHEN pu_borough = 'Unknown' OR do_borough = 'Unknown' THEN 1 ELSE 0 END AS q_unknown_zone,
         CASE WHEN passengers = 0 THEN 1 ELSE 0 END AS q_missing_passengers
  FROM t),
""" + _ISSUES
TEXTS = ", pickup_text, dropoff_text, passengers_text, distance_text, fare_text, tip_text, total_text"
LANDED = """
WITH n AS (SELECT n_nationkey AS k, r_name AS borough, n_name AS zone FROM nation JOIN region ON n_regionkey = r_regionkey),
e AS (
  SELECT *, CASE WHEN event_id % 97 = 0 THEN 'timestamp of another shape' WHEN event_id % 89 = 0 THEN 'no such time'
                 WHEN event_id % 83 = 0 THEN 'missing timestamp' END AS reason,
         CASE WHEN event_id % 31 = 0 THEN 1234.50 WHEN event_id % 37 = 0 OR event_id % 41 = 0 THEN NULL
              ELSE CAST(value AS DECIMAL(12,2)) END AS v
  FROM events)
"""


def _profile() -> str:
    commas, words = "event_id % 31 = 0", "event_id % 31 <> 0 AND event_id % 37 = 0"
    checks = {"timestamps of another shape": "reason IN ('timestamp of another shape', 'missing timestamp')", "ehail_fee missing": "TRUE"}
    for c in ("distance", "fare", "total"):
        checks |= {f"{c}: thousands separated by commas": commas, f"{c}: no number even without commas": words}
    one = "SELECT '{0}' AS issue, COUNT(*) FILTER (WHERE {1}) AS rows, ROUND(100.0 * COUNT(*) FILTER (WHERE {1}) / COUNT(*), 3) AS pct FROM e"
    return f"{LANDED} SELECT * FROM ({' UNION ALL '.join(one.format(*c) for c in checks.items())}) WHERE rows > 0"


# Exact sums, then the arithmetic of the normal equations after taking out the means.
FITTED = f"""{TRADE}, r AS (
  SELECT distance AS x, minutes AS z, fare AS y FROM g
  WHERE rate_code = 1 AND issue_count = 0 AND distance BETWEEN 0.1 AND 48 AND minutes BETWEEN 1 AND 1800 AND fare > 0),
s AS (
  SELECT COUNT(*) AS n, CAST(SUM(x) AS DOUBLE) AS sx, CAST(SUM(z) AS DOUBLE) AS sz, CAST(SUM(y) AS DOUBLE) AS sy,
         CAST(SUM(x * x) AS DOUBLE) AS sxx, CAST(SUM(x * z) AS DOUBLE) AS sxz, CAST(SUM(z * z) AS DOUBLE) AS szz,
         CAST(SUM(x * y) AS DOUBLE) AS sxy, CAST(SUM(z * y) AS DOUBLE) AS szy FROM r),
m AS (SELECT *, sxx - sx * sx / n AS xx, sxz - sx * sz / n AS xz, szz - sz * sz / n AS zz, sxy - sx * sy / n AS xy, szy - sz * sy / n AS zy FROM s),
b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM m),
c AS (SELECT *, (sy - b1 * sx - b2 * sz) / n AS b0 FROM b)"""
ERROR = "abs(CAST(y AS DOUBLE) - (b0 + b1 * CAST(x AS DOUBLE) + b2 * CAST(z AS DOUBLE)))"
FLAT = "(SELECT fare FROM g WHERE rate_code = 2 AND fare > 0 GROUP BY fare ORDER BY COUNT(*) DESC, fare LIMIT 1)"
GAP = f"""{FITTED}, h AS (
  SELECT rate_code, CAST(fare AS DOUBLE) AS fare, CASE WHEN rate_code = 2 THEN CAST({FLAT} AS DOUBLE)
         ELSE ROUND(greatest(ROUND(b0, 6) + ROUND(b1, 6) * CAST(distance AS DOUBLE) + ROUND(b2, 6) * CAST(minutes AS DOUBLE), 0), 2) END AS expected
  FROM g, c WHERE rate_code IN (1, 2) AND issue_count = 0 AND fare > 0),
d AS (SELECT rate_code, CAST(ROUND(abs(fare - expected), 2) AS DECIMAL(18,2)) AS gap FROM h)
SELECT rate_code, COUNT(*) AS trips, {_mean('gap', 2)} AS mean_gap, COUNT(*) FILTER (WHERE gap > 5) AS off_tariff,
       ROUND(100.0 * CAST(COUNT(*) FILTER (WHERE gap > 5) AS DOUBLE) / COUNT(*), 2) AS pct_off_tariff
FROM d GROUP BY 1"""


def _tails() -> str:
    one = """SELECT '{0}' AS threshold, CAST(MIN({1}) AS DOUBLE) AS value
             FROM (SELECT {1} FROM g ORDER BY {1} DESC LIMIT (SELECT greatest(1, CAST(floor(COUNT({1}) * 0.001) AS BIGINT)) FROM g))"""
    return TRADE + " UNION ALL ".join(one.format(*x) for x in (("max_fare", "fare"), ("max_distance", "distance"), ("max_minutes", "minutes")))


def _reconciliation(places: int, least: int) -> str:
    return f"""{TRADE} SELECT CAST(ROUND({DISCREPANCY}, {places}) AS DOUBLE) AS discrepancy, COUNT(*) AS trips, {_mean('mta_tax', 3)} AS avg_mta_tax,
                      {_mean('improvement', 3)} AS avg_improvement, {_mean('congestion', 3)} AS avg_congestion,
                      COUNT(*) FILTER (WHERE congestion IS NULL) AS congestion_null
               FROM g WHERE q_total_mismatch = 1 GROUP BY 1 HAVING COUNT(*) >= {least}"""


def oracle_sql() -> dict[str, str]:
    found = _workflows(True) | {f"{k}_all_rows": v for k, v in _workflows(False).items()}
    summary = [
        f"""SELECT '{r}' AS rule, '{severity}' AS severity, CAST(SUM(q_{r}) AS BIGINT) AS flagged,
                   ROUND(100.0 * CAST(SUM(q_{r}) AS DOUBLE) / COUNT(*), 3) AS pct_of_trips, '{text}' AS description, '{invalid}' AS invalidates FROM g"""
        for r, (severity, text, invalid, _) in RULES.items()
    ]
    usable = {m: (USABLE[m], *MEANINGS[m]) for m in USABLE} | {"(all rules)": ("issue_count = 0", "rows that no rule has flagged", 14)}
    coverage = [
        f"""SELECT '{m}' AS measure, '{text}' AS meaning, {n} AS rules, COUNT(*) FILTER (WHERE {c}) AS usable_rows,
                   ROUND(100.0 * CAST(COUNT(*) FILTER (WHERE {c}) AS DOUBLE) / COUNT(*), 2) AS pct_of_trips FROM g"""
        for m, (c, text, n) in usable.items()
    ]
    headline = f"""SELECT COUNT(*) AS trips, COUNT(*) FILTER (WHERE issue_count = 0) AS clean_trips, COUNT(DISTINCT pu_zone) AS pickup_zones,
                          MIN(pickup_date) AS first_pickup, MAX(pickup_date) AS last_pickup,
                          ROUND(CAST(SUM(CASE WHEN {_if('total')} THEN total END) AS DOUBLE), 0) AS total_revenue,
                          {_mean('distance', 2, _if('distance'))} AS typical_miles, {_mean('minutes', 1, _if('duration'))} AS typical_minutes,
                          {_mean('fare', 2, _if('fare'))} AS typical_fare"""
    sums = ", ".join(f"ROUND(CAST(SUM(v) AS DOUBLE), 2) AS sum_{c}" for c in ("distance", "fare", "total"))
    found |= {
        "reconciliation": _reconciliation(2, 2),
        "reconciliation_by_hundreds": _reconciliation(-2, 500),
        "cleaning_impact": _impact(),
        "headline": f"""{TRADE} {headline} FROM g""",
        "headline_of_added_files": f"{FILE}, d AS (SELECT *, CAST(pickup_ts AS DATE) AS pickup_date FROM g) {headline} FROM d",
        "rules_of_added_files": FILE + " UNION ALL ".join(f"SELECT '{r}' AS rule, CAST(SUM(q_{r}) AS BIGINT) AS flagged FROM g" for r in RULES),
        "busiest_zones_of_added_files": f"""{FILE} SELECT pu_borough AS borough, pu_zone AS zone, COUNT(*) AS trips, {_mean("distance", 2, _if("distance"))} AS avg_miles,
                      {_mean("minutes", 1, _if("duration"))} AS avg_minutes, {_mean("fare", 2, _if("fare"))} AS avg_fare,
                      {_mean("CASE WHEN fare > 0 THEN CAST(100 * CAST(tip AS DOUBLE) / CAST(fare AS DOUBLE) AS DECIMAL(18,2)) END", 1, _if("tip", "fare"))} AS avg_tip_pct
               FROM g WHERE {_if("trip_count", "location")} GROUP BY 1, 2 ORDER BY trips DESC, borough, zone LIMIT 15""",
        "rule_summary": TRADE + " UNION ALL ".join(summary),
        "issue_distribution": f"{TRADE} SELECT issue_count AS issues, COUNT(*) AS trips, ROUND(100.0 * CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM g), 3) AS pct FROM g GROUP BY 1",
        "measure_coverage": TRADE + " UNION ALL ".join(coverage),
        "rule_sample": f"{TRADE} SELECT raw_id, fare, distance FROM g WHERE q_excessive_fare = 1 ORDER BY distance DESC, raw_id LIMIT 10",
        "browse_flagged": _browse("issue_count > 0"),
        "browse_clean": _browse("issue_count = 0"),
        "browse_all_with_raw": _browse("TRUE", TEXTS, FILE),
        "file_accounting": f"""{FILE} SELECT (SELECT COUNT(*) FROM line) AS "read", (SELECT COUNT(*) FROM line WHERE malformed) AS malformed, (SELECT COUNT(*) FROM g) AS kept,
                                      (SELECT COUNT(*) FROM line WHERE NOT malformed AND (pickup_text IS NULL OR pickup_text IN ('2024-01-01', '99/01/2024 01:00:00 AM'))) AS rejected""",
        "malformed_lines": f"""{FILE} SELECT raw_id, concat_ws(',', raw_id, coalesce(pickup_text, ''), dropoff_text, 'N', '1', user_id % 30, raw_id % 28, passengers_text, distance_text,
                                      CASE WHEN money_text LIKE '%,%' THEN concat('"', money_text, '"') ELSE coalesce(money_text, '') END, '0', '0', tip_text, '0', '', '0',
                                      CASE WHEN money_text LIKE '%,%' THEN concat('"', money_text, '"') ELSE coalesce(money_text, '') END, 1 + raw_id % 6, '1')
                                      || CASE WHEN raw_id % 101 <> 0 THEN ',,more' ELSE '' END AS line FROM line WHERE malformed""",
        "cast_losses": FILE + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", COUNT({text}) AS texts, COUNT({text}) - COUNT({value}) AS lost FROM g"
            for c, text, value in (("distance", "distance_text", "distance"), ("fare", "fare_text", "fare"), ("total", "total_text", "total"), ("tip", "tip_text", "tip"), ("passengers", "passengers_text", "passengers"),
                                   *((c, 1, 1) for c in ("extra", "mta_tax", "tolls", "improvement", "rate_code", "payment_type")), ("congestion", "NULL", "NULL"))
        ),
        "browse_rule": _browse("q_excessive_fare = 1"),
        "browse_count": f"{TRADE} SELECT COUNT(*) FILTER (WHERE issue_count > 0) AS matching FROM g",
        "derive_thresholds": _tails(),
        "flag_rows": f"{TRADE} SELECT raw_id, issue_count, {', '.join(f'q_{r}' for r in RULES)} FROM g",
        "enrich_left_join": f"""{LANDED} SELECT event_id AS raw_id, coalesce(p.borough, 'Unknown') AS pu_borough, coalesce(p.zone, 'Unknown') AS pu_zone,
                                       coalesce(d.borough, 'Unknown') AS do_borough, coalesce(d.zone, 'Unknown') AS do_zone
                                FROM e LEFT JOIN n p ON user_id % 30 = p.k LEFT JOIN n d ON event_id % 28 = d.k WHERE reason IS NULL""",
        "derived_columns": f"""{LANDED} SELECT event_id AS raw_id, CAST(0 AS DOUBLE) AS minutes, CAST(NULL AS DOUBLE) AS mph, CASE WHEN v > 0 THEN CAST(0 AS DOUBLE) END AS tip_pct,
                                      CAST(ts AS DATE) AS pickup_date, CAST(hour(ts) AS INT) AS hour, CAST(dayofweek(ts) + 1 AS INT) AS dow, CAST(month(ts) AS INT) AS month
                               FROM e WHERE reason IS NULL""",
        "profile_raw": _profile(),
        "landing_cast": f"""{LANDED} SELECT coalesce(borough, 'Unknown') AS pu_borough, CAST(hour(ts) AS INT) AS hour, COUNT(*) AS trips, COUNT(v) AS fares, {sums}
                            FROM e LEFT JOIN n ON user_id % 30 = k WHERE reason IS NULL GROUP BY 1, 2""",
        "rejects": f"""{LANDED} SELECT event_id AS raw_id, reason, strftime(ts, '%m/%d/%Y %I:%M:%S %p') AS dropoff,
                              CASE reason WHEN 'no such time' THEN '99/01/2024 01:00:00 AM' WHEN 'timestamp of another shape' THEN '2024-01-01' END AS pickup
                       FROM e WHERE reason IS NOT NULL ORDER BY event_id LIMIT 50""",
        "tariff_fit": f"{FITTED} SELECT n AS rows_fitted, ROUND(b0, 3) AS base, ROUND(b1, 3) AS per_mile, ROUND(b2, 3) AS per_minute FROM c",
        "tariff_errors": f"{FITTED} SELECT ROUND(quantile_cont({ERROR}, 0.5), 2) AS median_error, ROUND(quantile_cont({ERROR}, 0.95), 2) AS p95_error FROM r, c",
        "tariff_gap_udf": GAP,
        "tariff_gap": GAP,
        "tariff_gap_sql_function": GAP,
        "flat_fare_mode": f"{TRADE} SELECT 2 AS rate_code, CAST({FLAT} AS DOUBLE) AS fare",
        "bench_revenue_by_borough": f"{TRADE} SELECT pu_borough AS borough, COUNT(*) AS trips, ROUND(CAST(SUM(total) AS DOUBLE), 2) AS revenue FROM g GROUP BY 1",
        "bench_distance_by_hour": f"{TRADE} SELECT hour, COUNT(*) AS trips, ROUND(CAST(SUM(distance) AS DOUBLE), 2) AS miles FROM g GROUP BY 1",
        "bench_event_distance_by_hour": f"{EVENTS} SELECT hour, COUNT(*) AS trips, ROUND(CAST(SUM(distance) AS DOUBLE), 2) AS miles FROM g GROUP BY 1",
        "bench_flagged_distribution": f"{TRADE} SELECT issue_count AS issues, COUNT(*) AS trips FROM g GROUP BY 1",
    }
    by_cube = [*_workflows(True), *(f"{k}_all_rows" for k in _workflows(False)), "cleaning_impact", "headline", "rule_summary", "issue_distribution", "measure_coverage"]
    of_rows = ["bench_revenue_by_borough", "bench_distance_by_hour", "bench_event_distance_by_hour", "bench_flagged_distribution"]
    return found | {f"{k}_by_cube": found[k] for k in by_cube} | {f"{k}_of_rows": found[k] for k in of_rows}
