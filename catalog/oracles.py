"""SQL twins of the registered queries, for an independent engine on the same parquet tables.

``PARTS`` are named common table expressions; ``ORACLES`` are final selects. A final select is prefixed with
the parts it mentions, directly or through other parts.
"""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}
ORACLES: dict[str, str] = {}

PARTS["ridership_raw"] = """
SELECT event_id, ts AS transit_timestamp, 'R' || (user_id % 20) AS bus_route, event_type AS payment_method,
       'F' || (event_id % 8) AS fare_class, CAST(floor(value) AS BIGINT) AS ridership,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS transfers, user_id
FROM events"""

PARTS["ridership_text"] = """
SELECT event_id,
       CASE WHEN event_id % 97 = 0 THEN 'not a time' ELSE strftime(transit_timestamp, '%m/%d/%Y %I:%M:%S %p') END
         AS transit_timestamp,
       bus_route, payment_method, fare_class AS fare_class_category, ridership, transfers
FROM ridership_raw"""

PARTS["mode_days"] = """
SELECT event_type AS series_key, CAST(ts AS DATE) AS day,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS y
FROM events GROUP BY ALL"""

PARTS["mode_pct"] = """
SELECT series_key, day, 100.0::DOUBLE * y / avg(y) OVER (PARTITION BY series_key) AS pct FROM mode_days"""

PARTS["mode_wide"] = """
SELECT day, max(y) FILTER (WHERE series_key = 'click') AS click, max(y) FILTER (WHERE series_key = 'error') AS error,
       max(y) FILTER (WHERE series_key = 'purchase') AS purchase, max(y) FILTER (WHERE series_key = 'signup') AS signup,
       max(y) FILTER (WHERE series_key = 'view') AS view
FROM mode_days GROUP BY day"""

PARTS["order_days"] = """
SELECT CAST(o_orderdate AS DATE) AS day,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS y
FROM orders GROUP BY 1"""

PARTS["stop_dim"] = """
SELECT s_suppkey AS stop_id, s_name AS stop, s_nationkey AS region,
       32.6::DOUBLE + ((s_suppkey * 37) % 600) * 0.001::DOUBLE AS lat,
       -80.2::DOUBLE + ((s_suppkey * 91) % 400) * 0.001::DOUBLE AS lng,
       s_suppkey % 6 = 0 AS active
FROM supplier"""

PARTS["trip_requests"] = """
SELECT event_id AS request_id, ts AS requested_at, user_id AS rider_id,
       'Supplier#' || lpad(CAST((event_id * 7) % k AS VARCHAR), 9, '0') AS dep_stop,
       'Supplier#' || lpad(CAST((event_id * 11 + 5) % k AS VARCHAR), 9, '0') AS dst_stop,
       lpad(CAST(((event_id * 13) % 1440) // 60 AS VARCHAR), 2, '0') || ':' ||
       lpad(CAST(((event_id * 13) % 1440) % 60 AS VARCHAR), 2, '0') AS arrive_by
FROM events, (SELECT count(*) + 3 AS k FROM supplier) WHERE event_type = 'click'"""

PARTS["arrivals"] = """
SELECT *, greatest(0, date_sub('hour', requested_at, arrival_at)) AS hours_ahead
FROM (SELECT *, CASE WHEN today_at <= requested_at THEN today_at + INTERVAL 1 DAY ELSE today_at END AS arrival_at
      FROM (SELECT *, date_trunc('day', requested_at) + to_hours(CAST(split_part(arrive_by, ':', 1) AS INTEGER))
                      + to_minutes(CAST(split_part(arrive_by, ':', 2) AS INTEGER)) AS today_at
            FROM trip_requests))"""

PARTS["located"] = """
SELECT r.*, 'R' || (rider_id % 20) AS route,
       a.stop_id AS dep_id, a.lat AS dep_lat, a.lng AS dep_lng, b.stop_id AS dst_id, b.lat AS dst_lat, b.lng AS dst_lng
FROM arrivals r LEFT JOIN stop_dim a ON r.dep_stop = a.stop LEFT JOIN stop_dim b ON r.dst_stop = b.stop"""

PARTS["trips"] = """
SELECT *, least(dep_lat, dst_lat) AS south, least(dep_lng, dst_lng) AS west,
       greatest(dep_lat, dst_lat) AS north, greatest(dep_lng, dst_lng) AS east,
       round(2 * 3958.7613::DOUBLE * asin(sqrt(least(1.0::DOUBLE,
         pow(sin(radians(dst_lat - dep_lat) / 2), 2)
         + cos(radians(dep_lat)) * cos(radians(dst_lat)) * pow(sin(radians(dst_lng - dep_lng) / 2), 2)))), 6) AS miles
FROM located WHERE dep_id IS NOT NULL AND dst_id IS NOT NULL"""

PARTS["flow_facts"] = """
SELECT event_id AS flow_id, user_id % (SELECT count(*) FROM supplier) AS stop_id, ts AS observed_at,
       5 + CAST(floor(value) AS BIGINT) % 36 AS mph, 40::BIGINT AS free_mph
FROM events WHERE event_type = 'view'"""

PARTS["flow_found"] = """
SELECT d.request_id, d.mph AS dep_mph, d.free_mph AS dep_free_mph, e.mph AS dst_mph, e.free_mph AS dst_free_mph
FROM (SELECT t.request_id, f.mph, f.free_mph FROM trips t ASOF LEFT JOIN flow_facts f
      ON t.dep_id = f.stop_id AND t.requested_at >= f.observed_at) d
JOIN (SELECT t.request_id, f.mph, f.free_mph FROM trips t ASOF LEFT JOIN flow_facts f
      ON t.dst_id = f.stop_id AND t.requested_at >= f.observed_at) e USING (request_id)"""

PARTS["incident_facts"] = """
SELECT event_id AS incident_id, 32.6::DOUBLE + (event_id % 600) * 0.001::DOUBLE AS lat,
       -80.2::DOUBLE + ((event_id * 3) % 400) * 0.001::DOUBLE AS lng,
       CAST(json_extract_string(props, '$.k') AS BIGINT) % 12 AS icon_category,
       ts AS valid_from, CASE WHEN event_id % 211 <> 0 THEN ts + INTERVAL 2 HOUR END AS valid_to
FROM events WHERE event_type = 'error'"""

PARTS["incident_pairs"] = """
SELECT request_id, incident_id, icon_category, lat, lng
FROM trips JOIN incident_facts ON lat BETWEEN south AND north AND lng BETWEEN west AND east
  AND valid_from <= requested_at AND (valid_to IS NULL OR requested_at < valid_to)"""


def hourly(key: str) -> str:
    return f"""
SELECT {key} AS series_key, date_trunc('hour', transit_timestamp) AS ts, CAST(sum(ridership) AS BIGINT) AS y
FROM ridership_raw GROUP BY ALL"""


PARTS["payment_hours"] = hourly("payment_method")
PARTS["route_hours"] = hourly("bus_route")
PARTS["rider_hours"] = hourly("user_id")
PARTS["cell_hours"] = hourly("bus_route || '/' || payment_method")


def seasonal_hours(source: str) -> str:
    return f"""
SELECT l.series_key, step, l.last_ts + to_hours(CAST(step AS INTEGER)) AS ts, n,
       round(q[1], 6) AS q10, round(q[2], 6) AS q50, round(q[3], 6) AS q90,
       CAST(floor(round(q[2], 6)) AS BIGINT) AS prediction
FROM (SELECT series_key, max(ts) AS last_ts FROM {source} GROUP BY 1) l
CROSS JOIN (SELECT unnest(generate_series(1::BIGINT, 24::BIGINT)) AS step) s
JOIN (SELECT series_key, hour(ts) AS phase, count(*) AS n, quantile_cont(y::DOUBLE, [0.1, 0.5, 0.9]) AS q
      FROM {source} GROUP BY 1, 2) p
  ON p.series_key = l.series_key AND p.phase = hour(l.last_ts + to_hours(CAST(step AS INTEGER)))"""


PARTS["payment_forecast"] = seasonal_hours("payment_hours")
PARTS["route_forecast"] = seasonal_hours("route_hours")

PARTS["riders_ahead"] = """
SELECT route, hour(arrival_at) AS phase, CAST(requested_at AS DATE) AS day,
       CAST(floor(round(quantile_cont(y::DOUBLE, 0.5), 6)) AS BIGINT) AS prediction
FROM (SELECT DISTINCT route, arrival_at, requested_at FROM trips) JOIN route_hours
  ON series_key = route AND hour(ts) = hour(arrival_at) AND ts < date_trunc('day', requested_at)
GROUP BY ALL"""

PARTS["bundle"] = """
SELECT t.*, f.prediction AS predicted_riders, dep_mph, dep_free_mph, dst_mph, dst_free_mph, coalesce(i.n, 0) AS incidents,
       coalesce(by_category, '') AS by_category
FROM trips t
LEFT JOIN riders_ahead f ON f.route = t.route AND f.phase = hour(t.arrival_at) AND f.day = CAST(t.requested_at AS DATE) AND t.hours_ahead > 0
LEFT JOIN flow_found USING (request_id)
LEFT JOIN (SELECT request_id, CAST(sum(n) AS BIGINT) AS n, string_agg(format('{:02d}:{}', kind, n), ',' ORDER BY kind) AS by_category
           FROM (SELECT request_id, coalesce(icon_category, -1) AS kind, count(*) AS n FROM incident_pairs GROUP BY 1, 2) GROUP BY 1) i USING (request_id)"""

PARTS["speeds"] = """
SELECT *, CAST(floor(least(dep_mph * 100 / dep_free_mph, dst_mph * 100 / dst_free_mph)) AS BIGINT) AS flow_percent,
       CASE WHEN coalesce(dep_mph, dst_mph) IS NOT NULL THEN greatest(5, least(40, least(dep_mph, dst_mph))) END AS speed,
       greatest(0, CAST(floor(miles * 14 + 0.5) AS BIGINT) - 200) AS savings_cents
FROM bundle"""

PARTS["scored"] = """
SELECT *, CASE least(3, rank + CASE WHEN incidents >= 3 THEN 1 ELSE 0 END)
            WHEN 1 THEN 'Light' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Heavy' END AS density
FROM (SELECT *, CAST(ceil(round(miles * 60 / speed, 6)) AS BIGINT) AS travel_minutes,
             CASE WHEN flow_percent IS NULL THEN NULL WHEN flow_percent >= 80 THEN 1 WHEN flow_percent >= 50 THEN 2 ELSE 3 END AS rank
      FROM speeds) WHERE rank IS NOT NULL
UNION ALL BY NAME
SELECT *, NULL::BIGINT AS travel_minutes, NULL::INTEGER AS rank, NULL::VARCHAR AS density FROM speeds WHERE flow_percent IS NULL"""

PARTS["texts"] = """
SELECT *, (savings_cents // 100) || '.' || lpad(CAST(savings_cents % 100 AS VARCHAR), 2, '0') AS savings_text,
       CASE density WHEN 'Light' THEN '0.50' WHEN 'Medium' THEN '1.00' WHEN 'Heavy' THEN '2.00' END AS credit_text
FROM scored"""

PARTS["messages"] = """
SELECT *, 'Traffic on this route is ' || lower(density) || '; the bus needs about ' || travel_minutes || ' min'
          || CASE WHEN savings_cents > 0 THEN ' and keeps $' || savings_text || ' in your pocket' ELSE '' END || '.'
          || CASE WHEN predicted_riders IS NULL THEN '' ELSE ' Around ' || predicted_riders || ' riders are expected.' END
          AS nudge
FROM texts"""

PARTS["offered"] = "SELECT * FROM scored WHERE travel_minutes <> 0 AND density IS NOT NULL"

PARTS["bodies"] = """
SELECT request_id, CASE WHEN request_id % 23 = 0 THEN substr(body, 1, 20) ELSE body END AS body,
       request_id % 17 = 0 AS no_departure, request_id % 19 = 0 AS no_time, request_id % 23 = 0 AS cut, dep_id, dst_id
FROM (SELECT *, '{' || CASE WHEN request_id % 17 <> 0 THEN '"departure":' ||
        coalesce('{"lat":' || dep_lat || ',"lng":' || dep_lng || '}', 'null') || ',' ELSE '' END
        || '"destination":' || coalesce('{"lat":' || dst_lat || ',"lng":' || dst_lng || '}', 'null')
        || ',"timeToDestination":"' || CASE WHEN request_id % 19 = 0 THEN '' ELSE arrive_by END || '"}' AS body
      FROM located)"""

PARTS["responses"] = """
SELECT event_id AS response_id, event_id % 41 = 0 AS cut,
       CASE WHEN event_id % 41 = 0 THEN left(body, length(body) - 3) ELSE body END AS response
FROM (SELECT event_id, '{' || concat_ws(',',
        CASE WHEN event_id % 5 <> 0 THEN '"travelTime":' || k END,
        CASE WHEN event_id % 5 <> 1 THEN '"trafficDensity":' || CASE WHEN event_id % 10 = 4 THEN 'null' ELSE
          '"' || (['Light', 'Medium', 'Heavy', 'Severe'])[event_id % 4 + 1] || '"' END END,
        CASE WHEN event_id % 5 <> 2 THEN '"costSavingsPerTrip":"' || (k % 7) || '.50"' END,
        CASE WHEN event_id % 5 <> 3 THEN '"nudgeMessage":"trip ' || event_id || '"' END,
        CASE WHEN event_id % 6 <> 5 THEN '"incentiveDetails":{"type":"'
          || (['eCredit', 'partnerDiscount', 'funReward', 'cash'])[event_id % 4 + 1]
          || '","description":"reward ' || event_id || '"'
          || CASE WHEN event_id % 7 <> 0 THEN ',"value":"$' || (k % 3) || '"' ELSE '' END || '}' END,
        '"additionalRides":[]') || '}' AS body
      FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""

PARTS["response_json"] = """
SELECT response_id, json_valid(response) AS ok, CASE WHEN json_valid(response) THEN response END AS js FROM responses"""

PARTS["response_gaps"] = """
SELECT response_id,
       CASE WHEN ok THEN list_filter(['travelTime', 'trafficDensity', 'costSavingsPerTrip', 'nudgeMessage', 'incentiveDetails'],
                                     lambda f: NOT list_contains(json_keys(js), f)) END AS missing,
       CASE WHEN json_extract(js, '$.incentiveDetails') IS NOT NULL THEN
         list_filter(['type', 'description', 'value'],
                     lambda f: NOT list_contains(json_keys(js, '$.incentiveDetails'), f)) END AS missing_incentive
FROM response_json"""

PARTS["horizons"] = """
SELECT request_id, series_key, asked_at, horizon_text,
       CASE WHEN regexp_full_match(horizon_text, '[0-9]+') THEN CAST(horizon_text AS BIGINT) END AS horizon
FROM (SELECT event_id AS request_id, event_type AS series_key, ts AS asked_at,
             CASE WHEN event_id % 13 = 0 THEN 'soon' WHEN event_id % 17 = 0 THEN '-3'
                  ELSE CAST(event_id % 60 AS VARCHAR) END AS horizon_text FROM events)"""

PARTS["answers"] = """
SELECT h.*, CASE WHEN horizon <= 0 THEN 0 ELSE CAST(floor(round(q50, 6)) AS BIGINT) END AS prediction
FROM horizons h
LEFT JOIN (SELECT series_key, max(ts) AS last_ts FROM payment_hours GROUP BY 1) l USING (series_key)
LEFT JOIN (SELECT series_key, hour(ts) AS phase, quantile_cont(y::DOUBLE, 0.5) AS q50 FROM payment_hours GROUP BY 1, 2) p
  ON p.series_key = h.series_key AND p.phase = hour(l.last_ts + to_hours(CAST(h.horizon AS INTEGER)))"""

PARTS["registrations"] = """
SELECT c_custkey AS record_id, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_name END AS name,
       'rider' || c_custkey || CASE WHEN c_custkey % 9 = 0 THEN '.example.com' ELSE '@example.com' END AS email,
       'pw' || (c_custkey * 31 % 1000) AS password,
       'pw' || (c_custkey * 31 % 1000) || CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE '' END AS confirm_password
FROM customer"""

# --- stops, requests, sources ---------------------------------------------------------------------------

ORACLES["stops_dim"] = "SELECT * FROM stop_dim"
ORACLES["active_stops_semi"] = "SELECT stop_id, stop, region, lat, lng FROM stop_dim WHERE active"
ORACLES["stops_distinct"] = "SELECT DISTINCT stop FROM stop_dim"
ORACLES["parse_ampm"] = """
SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN date_trunc('second', transit_timestamp) END AS ts FROM ridership_raw"""
ORACLES["ridership_parsed"] = """
SELECT date_trunc('second', transit_timestamp) AS transit_timestamp, bus_route, payment_method, fare_class, ridership, transfers
FROM ridership_raw WHERE event_id % 97 <> 0"""
ORACLES["ridership_quarantine"] = """
SELECT 'Unreadable ridership row' AS error, 'transit_timestamp' AS details,
       '{"transit_timestamp":"' || transit_timestamp || '","bus_route":"' || bus_route || '","payment_method":"' || payment_method
       || '","fare_class_category":"' || fare_class_category || '","ridership":' || ridership || ',"transfers":' || transfers || '}'
         AS payload
FROM ridership_text WHERE event_id % 97 = 0"""
ORACLES["parse_dates"] = """
SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 53 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders"""
ORACLES["requests_from_json"] = """
SELECT request_id, CAST(json_extract_string(js, '$.departure.lat') AS DOUBLE) AS dep_lat,
       CAST(json_extract_string(js, '$.departure.lng') AS DOUBLE) AS dep_lng,
       CAST(json_extract_string(js, '$.destination.lat') AS DOUBLE) AS dst_lat,
       CAST(json_extract_string(js, '$.destination.lng') AS DOUBLE) AS dst_lng,
       json_extract_string(js, '$.timeToDestination') AS arrive_by, js IS NOT NULL AS is_json
FROM (SELECT request_id, CASE WHEN json_valid(body) THEN body END AS js FROM bodies)"""
ORACLES["json_requests_split"] = """
SELECT request_id, CASE WHEN fields = '' AND places = '' THEN 'accepted' ELSE 'rejected' END AS outcome,
       CASE WHEN fields <> '' THEN 'Missing required fields: ' || fields WHEN places <> '' THEN 'Unknown stop: ' || places ELSE '' END AS reason
FROM (SELECT request_id,
        concat_ws(',', CASE WHEN cut OR no_departure OR (request_id % 29 <> 0 AND (request_id % 31 = 0 OR dep_id IS NULL)) THEN 'departure' END,
          CASE WHEN cut OR (request_id % 43 <> 0 AND (request_id % 47 = 0 OR dst_id IS NULL)) THEN 'destination' END,
          CASE WHEN cut OR no_time OR request_id % 37 = 0 THEN 'timeToDestination' END) AS fields,
        concat_ws(',', CASE WHEN request_id % 29 = 0 THEN 'departure' END, CASE WHEN request_id % 43 = 0 THEN 'destination' END) AS places
      FROM bodies)"""
ORACLES["request_rejects"] = """
SELECT request_id, 'Missing required fields' AS error, details, body AS payload
FROM (SELECT request_id, body, concat_ws(',', CASE WHEN cut OR no_departure OR dep_id IS NULL THEN 'departure' END,
        CASE WHEN cut OR dst_id IS NULL THEN 'destination' END, CASE WHEN cut OR no_time THEN 'timeToDestination' END) AS details
      FROM bodies) WHERE details <> ''"""

# --- projections and validation -------------------------------------------------------------------------

ORACLES["trunc_vs_floor"] = """
SELECT event_id, CAST(trunc(value - 50) AS BIGINT) AS truncated, CAST(floor(value - 50) AS BIGINT) AS floored FROM events"""
ORACLES["round_js"] = """
SELECT event_id, CAST(floor(floor(value) - 50 + (event_id % 4) * 0.5::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS rounded FROM events"""
ORACLES["incidents_flat"] = """
SELECT event_id AS feed_id, position, 'Feature' AS type, 'Point' AS geometry_type,
       ((event_id + position) % 400) + 0.5::DOUBLE AS lng, ((event_id + position) % 600) + 0.25::DOUBLE AS lat,
       (CAST(json_extract_string(props, '$.k') AS BIGINT) + position) % 12 AS icon_category
FROM events, (SELECT unnest([0::BIGINT, 1::BIGINT]) AS position) WHERE position < event_id % 3"""
ORACLES["valid_clock_text"] = """
SELECT event_id, regexp_matches(t, '^(0?[1-9]|1[0-2]):[0-5][0-9] ?(am|pm)$', 'i') AS is_valid
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%H:%M') WHEN 1 THEN lower(strftime(ts, '%I:%M%p'))
        WHEN 2 THEN strftime(ts, '%-I:%M %p') || ' ' ELSE strftime(ts, '%-I:%M %p') END AS t FROM events)"""
ORACLES["enum_violations"] = """
SELECT response_id, concat_ws(',', CASE WHEN density NOT IN ('Light', 'Medium', 'Heavy') THEN 'trafficDensity' END,
       CASE WHEN incentive_type NOT IN ('eCredit', 'partnerDiscount', 'funReward') THEN 'incentiveType' END) AS reasons,
       density, incentive_type
FROM (SELECT response_id, json_extract_string(js, '$.trafficDensity') AS density,
             json_extract_string(js, '$.incentiveDetails.type') AS incentive_type FROM response_json WHERE ok)
WHERE density NOT IN ('Light', 'Medium', 'Heavy') OR incentive_type NOT IN ('eCredit', 'partnerDiscount', 'funReward')"""
ORACLES["missing_keys"] = """
SELECT response_id, array_to_string(missing, ',') AS missing, array_to_string(missing_incentive, ',') AS missing_incentive
FROM response_gaps"""
ORACLES["missing_key_counts"] = """
SELECT key, count(*) AS n FROM (
  SELECT unnest(missing) AS key FROM response_gaps
  UNION ALL SELECT 'incentiveDetails.' || unnest(missing_incentive) FROM response_gaps) GROUP BY 1"""
ORACLES["parse_or_reject"] = """
SELECT response_id, CAST(json_extract_string(js, '$.travelTime') AS BIGINT) AS travel_minutes,
       json_extract_string(js, '$.trafficDensity') AS density,
       CASE WHEN NOT ok THEN 'Response is not valid JSON' END AS error
FROM response_json"""
ORACLES["coalesced_trip"] = """
SELECT response_id, coalesce(CAST(json_extract_string(js, '$.travelTime') AS BIGINT), 0) AS travel_minutes,
       coalesce(json_extract_string(js, '$.trafficDensity'), 'unknown') AS density,
       coalesce(json_extract_string(js, '$.costSavingsPerTrip'), '0.00') AS savings, 0::BIGINT AS n_rides
FROM response_json WHERE ok"""
ORACLES["unwrap_prediction"] = """
SELECT event_id AS payload_id,
       CASE WHEN event_id % 6 < 3 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS prediction FROM events"""
ORACLES["rule_report"] = """
SELECT record_id, reasons = '' AS accepted, reasons
FROM (SELECT record_id, concat_ws(',', CASE WHEN name = '' THEN 'name' END,
        CASE WHEN NOT regexp_full_match(email, '[^@ ]+@[^@ ]+[.][A-Za-z]+') THEN 'email' END,
        CASE WHEN password <> confirm_password THEN 'password_match' END) AS reasons FROM registrations)"""
ORACLES["stitch_chunks"] = """
SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, count(*) AS n_chunks FROM conversations GROUP BY 1"""

# --- series ---------------------------------------------------------------------------------------------

ORACLES["hourly_ridership"] = "SELECT * FROM payment_hours"
ORACLES["daily_ridership"] = """
SELECT bus_route AS series_key, CAST(transit_timestamp AS DATE) AS day, CAST(sum(ridership) AS BIGINT) AS y
FROM ridership_raw GROUP BY ALL"""
ORACLES["daily_mode_wide"] = """
SELECT day, round(100.0::DOUBLE * click / avg(click) OVER (), 6) AS click_pct,
       round(100.0::DOUBLE * error / avg(error) OVER (), 6) AS error_pct,
       round(100.0::DOUBLE * purchase / avg(purchase) OVER (), 6) AS purchase_pct,
       round(100.0::DOUBLE * signup / avg(signup) OVER (), 6) AS signup_pct,
       round(100.0::DOUBLE * view / avg(view) OVER (), 6) AS view_pct
FROM mode_wide"""
ORACLES["drop_null_days"] = """
SELECT day, click, error, purchase, signup, view FROM mode_wide
WHERE (day - DATE '1970-01-01') % 7 <> 0 AND click IS NOT NULL AND error IS NOT NULL AND purchase IS NOT NULL
  AND signup IS NOT NULL AND view IS NOT NULL"""
ORACLES["ridership_cube"] = """
SELECT bus_route, payment_method, fare_class, grouping_id(bus_route, payment_method, fare_class) AS grouping_level,
       CAST(sum(ridership) AS BIGINT) AS ridership, CAST(sum(transfers) AS BIGINT) AS transfers
FROM ridership_raw GROUP BY CUBE (bus_route, payment_method, fare_class)"""
ORACLES["transfer_ratio"] = """
SELECT bus_route, CAST(sum(transfers) AS BIGINT) AS transfers, CAST(sum(ridership) AS BIGINT) AS ridership,
       round(sum(transfers) / sum(ridership), 6) AS transfer_ratio
FROM ridership_raw GROUP BY 1"""
ORACLES["mean_daily_change"] = """
SELECT series_key, count(*) AS n, round(avg(d), 6) AS drift
FROM (SELECT series_key, pct - lag(pct) OVER (PARTITION BY series_key ORDER BY day) AS d FROM mode_pct) GROUP BY 1"""
ORACLES["series_coverage"] = """
SELECT c_custkey AS series_key, coalesce(n, 0) AS n_slots, coalesce(span, 0) AS span_slots,
       coalesce(span - n, 0) AS missing_slots, n IS NULL AS needs_fallback
FROM customer LEFT JOIN (SELECT series_key, count(*) AS n, date_diff('hour', min(ts), max(ts)) + 1 AS span
                         FROM rider_hours GROUP BY 1) ON series_key = c_custkey"""
ORACLES["hourly_diff"] = """
SELECT *, y - lag(y) OVER (PARTITION BY series_key ORDER BY ts) AS diff FROM payment_hours"""
PARTS["cell_spine"] = """
SELECT s.series_key, s.ts, h.y
FROM (SELECT series_key, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM cell_hours GROUP BY 1) s
LEFT JOIN cell_hours h ON h.series_key = s.series_key AND h.ts = s.ts"""
ORACLES["hour_gapfill"] = "SELECT series_key, ts, y FROM cell_spine"
ORACLES["ffill_hours"] = """
SELECT series_key, ts, y, last_value(y IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY ts
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y_filled
FROM cell_spine"""
ORACLES["last_known"] = """
SELECT series_key, max(day) AS day, round(arg_max(pct, day), 6) AS y FROM mode_pct GROUP BY 1"""
ORACLES["future_dates"] = """
SELECT 'orders' AS series_key, step, CAST(last_day + CAST(step AS INTEGER) AS DATE) AS day
FROM (SELECT max(day) AS last_day FROM order_days), (SELECT unnest(generate_series(1::BIGINT, 14::BIGINT)) AS step)"""
ORACLES["future_features"] = """
SELECT series_key, step, CAST(last_day + CAST(step AS INTEGER) AS DATE) AS day, round(last_y + step * drift, 6) AS y
FROM (SELECT series_key, max(day) AS last_day, arg_max(pct, day) AS last_y, avg(d) AS drift
      FROM (SELECT *, pct - lag(pct) OVER (PARTITION BY series_key ORDER BY day) AS d FROM mode_pct) GROUP BY 1),
     (SELECT unnest(generate_series(1::BIGINT, 5::BIGINT)) AS step)"""
ORACLES["days_newest_first"] = "SELECT day, y FROM order_days ORDER BY day DESC"

# --- forecasts ------------------------------------------------------------------------------------------

ORACLES["forecast_hourly"] = "SELECT * FROM payment_forecast"
ORACLES["forecast_daily"] = """
SELECT 'orders' AS series_key, step, CAST(last_day + CAST(step AS INTEGER) AS DATE) AS day, n,
       round(q[1], 6) AS q10, round(q[2], 6) AS q50, round(q[3], 6) AS q90, CAST(floor(round(q[2], 6)) AS BIGINT) AS prediction
FROM (SELECT max(day) AS last_day FROM order_days)
CROSS JOIN (SELECT unnest(generate_series(1::BIGINT, 14::BIGINT)) AS step)
JOIN (SELECT dayofweek(day) AS phase, count(*) AS n, quantile_cont(y, [0.1, 0.5, 0.9]) AS q FROM order_days GROUP BY 1)
  ON phase = dayofweek(CAST(last_day + CAST(step AS INTEGER) AS DATE))"""
PARTS["payment_filled"] = """
SELECT series_key, ts, last_value(y IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY ts
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y
FROM (SELECT s.series_key, s.ts, h.y
      FROM (SELECT series_key, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM payment_hours GROUP BY 1) s
      LEFT JOIN payment_hours h ON h.series_key = s.series_key AND h.ts = s.ts)"""
ORACLES["forecast_drift"] = """
SELECT c.series_key, step, last_ts + to_hours(CAST(step AS INTEGER)) AS ts, round(last_y + q[1], 6) AS q10,
       round(last_y + q[2], 6) AS q50, round(last_y + q[3], 6) AS q90, CAST(floor(round(last_y + q[2], 6)) AS BIGINT) AS prediction
FROM (SELECT a.series_key, step, quantile_cont((b.y - a.y)::DOUBLE, [0.1, 0.5, 0.9]) AS q
      FROM payment_filled a CROSS JOIN (SELECT unnest(generate_series(1::BIGINT, 24::BIGINT)) AS step) s
      JOIN payment_filled b ON b.series_key = a.series_key AND b.ts = a.ts + to_hours(CAST(step AS INTEGER))
      GROUP BY 1, 2) c
JOIN (SELECT series_key, max(ts) AS last_ts, arg_max(y, ts) AS last_y FROM payment_filled GROUP BY 1) l
  ON l.series_key = c.series_key"""
ORACLES["forecast_interval"] = "SELECT series_key, ts, q10, q50, q90, round(q90 - q10, 6) AS width FROM route_forecast"
ORACLES["forecast_request"] = "SELECT request_id, series_key, horizon, prediction FROM answers"
ORACLES["forecast_envelope"] = """
SELECT request_id, CASE WHEN horizon IS NULL THEN
         '{"error":"hourly forecast failed","details":"horizon is no whole number","hours_requested":"' || horizon_text
         || '","timestamp":"' || strftime(asked_at, '%Y-%m-%dT%H:%M:%S') || '"}'
       ELSE '{"prediction":' || prediction || ',"hours_future":' || horizon || ',"model_type":"hourly","timestamp":"'
         || strftime(asked_at, '%Y-%m-%dT%H:%M:%S') || '"}' END AS envelope
FROM answers"""


RIDERS = "SELECT c_custkey AS series_key, c_custkey % 25 AS horizon FROM customer"


def fallback(source: str, phase: str, shift: str, base: int, variation: int, asked: str = RIDERS) -> str:
    return f"""
SELECT c.*,
       CASE WHEN c.horizon <= 0 THEN 0 ELSE coalesce(CAST(floor(round(q50, 6)) AS BIGINT), CAST(floor(round(m, 6)) AS BIGINT),
            CAST(floor(round(g.y, 6)) AS BIGINT), {base - variation} + (c.series_key * 2654435761) % {2 * variation}) END AS prediction,
       CASE WHEN c.horizon <= 0 THEN 'none' WHEN q50 IS NOT NULL THEN 'phase' WHEN m IS NOT NULL THEN 'series'
            WHEN g.y IS NOT NULL THEN 'pooled' ELSE 'base' END AS source
FROM ({asked}) c
LEFT JOIN (SELECT series_key, max(ts) AS last_ts, quantile_cont(y::DOUBLE, 0.5) AS m FROM {source} GROUP BY 1) l
  ON l.series_key = c.series_key
LEFT JOIN (SELECT series_key, {phase}(ts) AS phase, quantile_cont(y::DOUBLE, 0.5) AS q50 FROM {source} GROUP BY 1, 2) p
  ON p.series_key = c.series_key AND p.phase = {phase}(l.last_ts + {shift}(CAST(c.horizon AS INTEGER)))
LEFT JOIN (SELECT {phase}(ts) AS phase, quantile_cont(y::DOUBLE, 0.5) AS y FROM {source} GROUP BY 1) g
  ON g.phase = {phase}((SELECT max(ts) FROM {source}) + {shift}(CAST(c.horizon AS INTEGER)))"""


PARTS["rider_days"] = """
SELECT user_id AS series_key, date_trunc('day', transit_timestamp) AS ts, CAST(sum(ridership) AS BIGINT) AS y
FROM ridership_raw GROUP BY ALL"""
ORACLES["forecast_with_fallback"] = fallback("rider_hours", "hour", "to_hours", 50, 20)
ORACLES["forecast_fallback_daily"] = fallback("rider_days", "dayofweek", "to_days", 10000, 2000)
SERVICE_RIDERS = """
SELECT *, CASE WHEN NOT failed THEN CAST(horizon_text AS BIGINT) END AS horizon
FROM (SELECT c_custkey AS series_key, c_custkey % 13 = 0 AS failed,
             CASE WHEN c_custkey % 13 = 0 THEN '1.5' ELSE CAST(c_custkey % 40 AS VARCHAR) END AS horizon_text FROM customer)"""


def service(answers: str, kind: str, unit: str) -> str:
    return f"""
SELECT series_key AS request_id, failed, CASE WHEN failed THEN
         '{{"error":"{kind} forecast failed","details":"horizon is no whole number","{unit}_requested":"' || horizon_text
       ELSE '{{"prediction":' || prediction || ',"{unit}_future":' || horizon || ',"model_type":"{kind}' END
       || '","timestamp":"2024-01-31T08:00:00"}}' AS envelope
FROM {answers}"""


PARTS["hourly_answers"] = fallback("rider_hours", "hour", "to_hours", 50, 20, SERVICE_RIDERS)
PARTS["daily_answers"] = fallback("rider_days", "dayofweek", "to_days", 10000, 2000, SERVICE_RIDERS)
ORACLES["service_hourly"] = service("hourly_answers", "hourly", "hours")
ORACLES["service_daily"] = service("daily_answers", "daily", "days")
ORACLES["forecast_pooled"] = """
SELECT hour(ts) AS phase, round(quantile_cont(y::DOUBLE, 0.5), 6) AS pooled_median, count(*) AS n_samples
FROM rider_hours GROUP BY 1"""
ORACLES["backtest_error"] = """
WITH past AS (SELECT hour(ts) + 1 AS step, y::DOUBLE AS actual, quantile_cont(y::DOUBLE, [0.1, 0.5, 0.9]) OVER (
               PARTITION BY series_key, hour(ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q
             FROM payment_hours),
res AS (SELECT step, actual, round(q[1], 6) AS q10, round(q[2], 6) AS q50, round(q[3], 6) AS q90 FROM past WHERE q IS NOT NULL)
SELECT step, count(*) AS n, round(avg((actual - q50) * (actual - q50)), 6) AS mse,
       round(avg(CASE WHEN actual <> 0 THEN abs(actual - q50) / abs(actual) END), 6) AS mape,
       round(avg(CASE WHEN actual BETWEEN q10 AND q90 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS coverage_80,
       CASE WHEN NOT isnan(corr(actual, q50)) THEN round(corr(actual, q50), 6) END AS trend_corr
FROM res GROUP BY 1"""

# --- regression -----------------------------------------------------------------------------------------

ORACLES["train_test_split"] = "SELECT day, ((day - DATE '1970-01-01') * 2654435761) % 100 < 80 AS in_train FROM order_days"
# Least squares by orthogonalising one centred feature after the other, then substituting back.
PARTS["mode_features"] = """
SELECT day, max(pct) FILTER (WHERE series_key = 'click') AS x1, max(pct) FILTER (WHERE series_key = 'error') AS x2,
       max(pct) FILTER (WHERE series_key = 'signup') AS x3, max(pct) FILTER (WHERE series_key = 'view') AS x4,
       max(y) FILTER (WHERE series_key = 'purchase') AS y
FROM mode_pct JOIN mode_days USING (series_key, day) GROUP BY day"""
PARTS["ols_means"] = """
SELECT avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(x4) AS m4, avg(y) AS my FROM mode_features
WHERE ((day - DATE '1970-01-01') * 2654435761) % 100 < 80"""
PARTS["ols_z1"] = """
SELECT x1 - m1 AS z1, x2 - m2 AS c2, x3 - m3 AS c3, x4 - m4 AS c4, y - my AS cy FROM mode_features, ols_means
WHERE ((day - DATE '1970-01-01') * 2654435761) % 100 < 80"""
PARTS["ols_z2"] = """
SELECT *, c2 - z1 * r12 AS z2 FROM (SELECT *, sum(z1 * c2) OVER () / sum(z1 * z1) OVER () AS r12 FROM ols_z1)"""
PARTS["ols_z3"] = """
SELECT *, c3 - z1 * r13 - z2 * r23 AS z3
FROM (SELECT *, sum(z1 * c3) OVER () / sum(z1 * z1) OVER () AS r13, sum(z2 * c3) OVER () / sum(z2 * z2) OVER () AS r23 FROM ols_z2)"""
PARTS["ols_z4"] = """
SELECT *, c4 - z1 * r14 - z2 * r24 - z3 * r34 AS z4
FROM (SELECT *, sum(z1 * c4) OVER () / sum(z1 * z1) OVER () AS r14, sum(z2 * c4) OVER () / sum(z2 * z2) OVER () AS r24,
             sum(z3 * c4) OVER () / sum(z3 * z3) OVER () AS r34 FROM ols_z3)"""
PARTS["ols_projections"] = """
SELECT any_value(r12) AS r12, any_value(r13) AS r13, any_value(r23) AS r23, any_value(r14) AS r14, any_value(r24) AS r24,
       any_value(r34) AS r34, sum(z1 * cy) / sum(z1 * z1) AS q1, sum(z2 * cy) / sum(z2 * z2) AS q2,
       sum(z3 * cy) / sum(z3 * z3) AS q3, sum(z4 * cy) / sum(z4 * z4) AS q4
FROM ols_z4"""
PARTS["ols_solution"] = """
SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 - b4 * m4 AS b0
FROM (SELECT *, q1 - r12 * b2 - r13 * b3 - r14 * b4 AS b1
      FROM (SELECT *, q2 - r23 * b3 - r24 * b4 AS b2
            FROM (SELECT *, q3 - r34 * q4 AS b3, q4 AS b4 FROM ols_projections))), ols_means"""
ORACLES["ols_fit"] = """
SELECT term, round(CASE term WHEN 'intercept' THEN b0 WHEN 'click_pct' THEN b1 WHEN 'error_pct' THEN b2
                   WHEN 'signup_pct' THEN b3 ELSE b4 END, 5) AS coefficient
FROM ols_solution, (SELECT unnest(['intercept', 'click_pct', 'error_pct', 'signup_pct', 'view_pct']) AS term)"""
ORACLES["ols_forecast"] = """
SELECT CAST(last_day + CAST(step AS INTEGER) AS DATE) AS day, step,
       round(b0 + b1 * (l1 + step * d1) + b2 * (l2 + step * d2) + b3 * (l3 + step * d3) + b4 * (l4 + step * d4), 4) AS prediction
FROM ols_solution,
     (SELECT max(day) AS last_day, arg_max(x1, day) AS l1, arg_max(x2, day) AS l2, arg_max(x3, day) AS l3, arg_max(x4, day) AS l4,
             avg(e1) AS d1, avg(e2) AS d2, avg(e3) AS d3, avg(e4) AS d4
      FROM (SELECT *, x1 - lag(x1) OVER w AS e1, x2 - lag(x2) OVER w AS e2, x3 - lag(x3) OVER w AS e3, x4 - lag(x4) OVER w AS e4
            FROM mode_features WINDOW w AS (ORDER BY day))),
     (SELECT unnest(generate_series(1::BIGINT, 5::BIGINT)) AS step)"""
ORACLES["ols_holdout"] = """
SELECT count(*) AS n, round(avg((y - p) * (y - p)), 2) AS mse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2
FROM (SELECT y, b0 + b1 * x1 + b2 * x2 + b3 * x3 + b4 * x4 AS p FROM mode_features, ols_solution
      WHERE ((day - DATE '1970-01-01') * 2654435761) % 100 >= 80)"""
ORACLES["ols_trend"] = """
SELECT series_key, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept,
       round(regr_r2(y, x), 6) AS r2
FROM (SELECT series_key, y, CAST(day - DATE '1970-01-01' AS DOUBLE) AS x FROM mode_days) GROUP BY 1"""

# --- trips ----------------------------------------------------------------------------------------------

ORACLES["trip_endpoints"] = "SELECT request_id, dep_stop, dep_lat, dep_lng, dst_stop, dst_lat, dst_lng FROM trips"
ORACLES["trip_unmatched"] = """
SELECT request_id, dep_stop, dst_stop, concat_ws(',', CASE WHEN dep_id IS NULL THEN 'departure' END,
       CASE WHEN dst_id IS NULL THEN 'destination' END) AS unknown
FROM located WHERE dep_id IS NULL OR dst_id IS NULL"""
ORACLES["trip_bbox"] = "SELECT request_id, south, west, north, east FROM trips"
ORACLES["arrival_resolved"] = """
SELECT request_id, requested_at, arrive_by, arrival_at, hours_ahead, hours_ahead > 48 AS long_horizon FROM arrivals"""
ORACLES["arrival_iso"] = """
SELECT request_id, strftime(arrival_at, '%Y-%m-%dT%H:%M:%S.000Z') AS utc_text,
       strftime(arrival_at + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S.000Z') AS new_york_as_utc
FROM arrivals"""
ORACLES["trip_distance"] = "SELECT request_id, miles FROM trips"
ORACLES["trip_co2_saved"] = "SELECT request_id, round(miles * 180 / 453.592::DOUBLE, 4) AS pounds_saved FROM trips"
ORACLES["trip_savings"] = """
SELECT request_id, greatest(0, CAST(floor(miles * 350 / 25 + 0.5) AS BIGINT) - 200) AS savings_cents FROM trips"""
ORACLES["flow_asof"] = "SELECT * FROM flow_found"
ORACLES["flow_nearest"] = """
WITH asked AS (
  SELECT request_id, requested_at, 32.5::DOUBLE + (request_id * 17 % 8000) * 0.0001::DOUBLE AS lat,
         -80.3::DOUBLE + (request_id * 29 % 6000) * 0.0001::DOUBLE AS lng FROM trip_requests),
near AS (
  SELECT request_id, requested_at, min((round(sqrt(pow(s.lat - a.lat, 2) + pow((s.lng - a.lng) * cos(radians(a.lat)), 2)), 9), stop_id)) AS best
  FROM asked a, stop_dim s GROUP BY ALL),
placed AS (SELECT request_id, requested_at, best[1] AS degrees, best[2] AS stop_id FROM near)
SELECT request_id, a.stop_id, degrees, mph, free_mph
FROM placed a ASOF LEFT JOIN flow_facts f ON a.stop_id = f.stop_id AND a.requested_at >= f.observed_at"""
ORACLES["incidents_in_bbox"] = "SELECT * FROM incident_pairs"
ORACLES["incident_categories"] = "SELECT request_id, icon_category, count(*) AS incidents FROM incident_pairs GROUP BY 1, 2"
ORACLES["incidents_polled"] = """
SELECT request_id, icon_category, count(*) AS incidents FROM incident_pairs WHERE incident_id % 41 <> 0 GROUP BY 1, 2"""
ORACLES["incident_load"] = "SELECT request_id, count(*) AS incidents FROM incident_pairs GROUP BY 1"
ORACLES["trip_ridership"] = "SELECT request_id, route, hours_ahead, predicted_riders FROM bundle"
ORACLES["traffic_bundle"] = "SELECT request_id, dep_mph, dst_mph, incidents, by_category, predicted_riders FROM bundle"
ORACLES["trip_density"] = "SELECT request_id, flow_percent, incidents, density FROM scored"
ORACLES["trip_travel_time"] = "SELECT request_id, miles, travel_minutes FROM scored"
ORACLES["be_at_stop"] = """
SELECT request_id, due AS be_at_stop, strftime(due, '%I:%M %p') AS be_at_stop_text
FROM (SELECT request_id, requested_at + to_minutes(CAST(travel_minutes - 10 AS INTEGER)) AS due FROM scored)"""
ORACLES["incentive_by_density"] = """
SELECT request_id, CASE density WHEN 'Light' THEN 1::BIGINT WHEN 'Medium' THEN 2 WHEN 'Heavy' THEN 4 END AS incentive_usd FROM scored"""
ORACLES["incentive_typed"] = """
SELECT request_id, CASE WHEN credit_text IS NOT NULL THEN (['eCredit', 'partnerDiscount', 'funReward'])[request_id % 3 + 1] END AS type,
       '$' || credit_text || ([' credit on the next ride', ' off at a partner shop', ' voucher for a treat'])[request_id % 3 + 1] AS description,
       '$' || credit_text AS value
FROM texts"""
ORACLES["nudge_text"] = "SELECT request_id, nudge FROM messages"
ORACLES["trip_display"] = """
SELECT request_id, coalesce(travel_minutes || ' mins', 'N/A') AS travel_time, coalesce(density, 'N/A') AS density,
       coalesce('$' || savings_text, 'N/A') AS savings
FROM texts"""
ORACLES["complete_trips"] = """
SELECT request_id, savings_cents, density, travel_minutes FROM scored
WHERE savings_cents <> 0 AND travel_minutes <> 0 AND density IS NOT NULL"""
PARTS["runner_ups"] = """
SELECT request_id, dst_id, density, travel_minutes,
       string_agg(request_id || ':' || travel_minutes || ':' || arrive_by, ';') OVER w AS next_rides,
       string_agg(arrive_by || ' ' || travel_minutes || ' mins ' || density, '; ') OVER w AS other_rides
FROM offered
WINDOW w AS (PARTITION BY dst_id, density ORDER BY travel_minutes, request_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"""
ORACLES["runner_up_rides"] = """
SELECT request_id, dst_id, density, travel_minutes, coalesce(next_rides, '') AS next_rides FROM runner_ups"""
ORACLES["topk_rides"] = """
SELECT * FROM (SELECT dst_id, request_id, travel_minutes,
                      row_number() OVER (PARTITION BY dst_id ORDER BY travel_minutes, request_id) AS position FROM offered)
WHERE position <= 3"""
ORACLES["trip_insights"] = """
SELECT m.request_id, m.travel_minutes, m.density, savings_text AS savings, nudge,
       CASE WHEN credit_text IS NOT NULL THEN (['eCredit', 'partnerDiscount', 'funReward'])[m.request_id % 3 + 1] END AS incentive_type,
       '$' || credit_text AS incentive_value, other_rides
FROM messages m LEFT JOIN runner_ups r ON r.request_id = m.request_id"""

ORACLES["insights_from_json"] = """
SELECT request_id, dep_stop, dst_stop, travel_minutes, density, savings_cents, nudge FROM messages
WHERE request_id % 17 <> 0 AND request_id % 19 <> 0 AND request_id % 23 <> 0"""
ORACLES["travel_time_results"] = """
SELECT t.request_id, t.travel_minutes, t.density, savings_text AS savings, coalesce(n_rides, 0) AS n_rides,
       '[' || coalesce(rides, '') || ']' AS rides
FROM texts t LEFT JOIN (
  SELECT request_id, count(*) OVER w AS n_rides,
         string_agg('{"departureTime":"' || arrive_by || '","travelTime":' || travel_minutes || ',"trafficDensity":"' || density || '"}', ',')
           OVER w AS rides
  FROM offered
  WINDOW w AS (PARTITION BY dst_id, density ORDER BY travel_minutes, request_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) r
  ON r.request_id = t.request_id"""

# --- impact ---------------------------------------------------------------------------------------------

ORACLES["emission_factors"] = """
SELECT mode, count(*) AS runs, CAST(sum(miles) AS BIGINT) AS vehicle_miles, CAST(sum(miles * passengers) AS BIGINT) AS passenger_miles,
       round(sum(miles) * CASE mode WHEN 'bus' THEN 2680.0::DOUBLE ELSE 404.0::DOUBLE END / sum(miles * passengers), 6)
         AS grams_per_passenger_mile,
       round(CASE mode WHEN 'bus' THEN 2680.0::DOUBLE / 30 ELSE 404.0::DOUBLE / 1.5 END, 6) AS standard_grams_per_passenger_mile
FROM (SELECT CASE l_linestatus WHEN 'O' THEN 'bus' ELSE 'car' END AS mode, CAST(l_linenumber AS BIGINT) AS miles,
             CASE l_linestatus WHEN 'O' THEN CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) % 4 + 1 END AS passengers
      FROM lineitem) GROUP BY mode"""
ORACLES["rider_emissions"] = """
SELECT rider_id, m AS miles_per_day, d AS days_per_year, round(m * bus, 4) AS bus_daily_grams, round(m * car, 4) AS car_daily_grams,
       round(m * d * bus / 1000, 4) AS bus_annual_kg, round(m * d * car / 1000, 4) AS car_annual_kg,
       round(m * (car - bus), 4) AS daily_grams_saved, round(m * d * (car - bus) / 1000, 4) AS annual_kg_saved,
       round(100 * (car - bus) / car, 4) AS percent_saved
FROM (SELECT c_custkey AS rider_id, 5 + c_custkey % 31 AS m, 200 + c_custkey % 61 AS d,
             2680.0::DOUBLE / 30 AS bus, 404.0::DOUBLE / 1.5::DOUBLE AS car FROM customer)"""
ORACLES["cost_index_long"] = """
SELECT criterion, round((car - bus) * 100.0::DOUBLE / car, 6) AS saving_percent, mode, CASE mode WHEN 'car' THEN car ELSE bus END AS percent
FROM (SELECT p_brand || '/' || p_type || '/' || p_partkey AS criterion, CAST(p_size AS BIGINT) + 50 AS car, CAST(p_size AS BIGINT) AS bus FROM part),
     (SELECT unnest(['car', 'bus']) AS mode)"""

# --- series, sinks and discovery ----------------------------------------------------------------------

ORACLES["ols_by_series"] = """
WITH d AS (SELECT bus_route, CAST(transit_timestamp AS DATE) AS day, sum(ridership)::DOUBLE AS y, sum(transfers)::DOUBLE AS x2, count(*)::DOUBLE AS x1
           FROM ridership_raw GROUP BY 1, 2),
s AS (SELECT bus_route, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS a, var_pop(x2) AS b,
             covar_pop(x1, x2) AS c, covar_pop(x1, y) AS p, covar_pop(x2, y) AS q FROM d GROUP BY 1),
k AS (SELECT *, CASE WHEN a > 0 AND b - c * c / a > 1e-10 * b THEN (p * b - q * c) / (a * b - c * c) END AS b1,
             CASE WHEN a > 0 AND b - c * c / a > 1e-10 * b THEN (q * a - p * c) / (a * b - c * c) END AS b2 FROM s)
SELECT bus_route, n, term, round(CASE term WHEN 'intercept' THEN my - b1 * m1 - b2 * m2 WHEN 'rides' THEN b1 ELSE b2 END, 5) AS coefficient
FROM k, (SELECT unnest(['intercept', 'rides', 'transfers']) AS term)"""
ORACLES["forecast_discovered"] = f"""
SELECT CAST(series_key AS VARCHAR) AS series_key, horizon, prediction, source FROM ({ORACLES["forecast_fallback_daily"]})"""
ORACLES["forecast_without_columns"] = """
SELECT CAST(c_custkey AS VARCHAR) AS series_key, c_custkey % 25 AS horizon, CASE WHEN c_custkey % 25 = 0 THEN 0
       ELSE 8000 + (c_custkey * 2654435761) % 4000 END AS prediction, CASE WHEN c_custkey % 25 = 0 THEN 'none' ELSE 'base' END AS source
FROM customer"""
PARTS["rejects"] = ORACLES["request_rejects"]
ORACLES["error_round_trip"] = """
SELECT run, error, details, count(*) AS n FROM (
  SELECT 'first' AS run, * FROM rejects UNION ALL SELECT 'second', * FROM rejects WHERE request_id % 2 = 0) GROUP BY ALL"""

# --- streaming ------------------------------------------------------------------------------------------

ORACLES["stream_hourly"] = """
SELECT series_key, ts AS hour, y,
       ts + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events) AS closed
FROM payment_hours"""
ORACLES["stream_unique_requests"] = "SELECT event_id AS request_id, ts FROM events"
ORACLES["stream_trip_insights"] = """
SELECT request_id, travel_minutes, density, savings_cents, nudge, NULL::VARCHAR AS rejected FROM messages
UNION ALL
SELECT request_id, NULL, NULL, NULL, NULL,
       concat_ws(',', CASE WHEN dep_id IS NULL THEN 'departure' END, CASE WHEN dst_id IS NULL THEN 'destination' END)
FROM located WHERE dep_id IS NULL OR dst_id IS NULL"""

# --- files and services ---------------------------------------------------------------------------------

ORACLES["hourly_csv_scan"] = """
SELECT date_trunc('second', transit_timestamp) AS transit_timestamp, bus_route, payment_method, fare_class, ridership, transfers
FROM ridership_raw WHERE event_id % 97 <> 0 AND event_id % 89 <> 0"""
ORACLES["hourly_csv_quarantine"] = """
SELECT 'Unreadable ridership row' AS error, CASE WHEN event_id % 97 = 0 THEN 'transit_timestamp' ELSE 'ridership' END AS details, count(*) AS n
FROM events WHERE event_id % 97 = 0 OR event_id % 89 = 0 GROUP BY ALL"""
PARTS["daily_lines"] = """
SELECT day, slot, slot % 41 = 0 AS bad_day, slot % 37 = 0 AS bad_total, round(y, 2) AS total,
       CASE WHEN slot % 10 <> 0 THEN CAST(slot % 100 AS DOUBLE) END AS part
FROM (SELECT *, day - DATE '1970-01-01' AS slot FROM order_days)"""
ORACLES["daily_csv_scan"] = """
SELECT day AS date, total AS buses_total_riders, part AS buses_pct_of_day FROM daily_lines WHERE NOT bad_day AND NOT bad_total"""
ORACLES["daily_csv_quarantine"] = """
SELECT 'Unreadable daily row' AS error,
       concat_ws(',', CASE WHEN bad_day THEN 'date' END, CASE WHEN bad_total THEN 'buses_total_riders' END) AS details,
       '{"Date":"' || CASE WHEN bad_day THEN 'someday' ELSE strftime(day, '%m/%d/%Y') END || '","Buses: Total Riders":"'
         || CASE WHEN bad_total THEN 'n/a' ELSE printf('%.2f', total) END || '"'
         || coalesce(',"Buses: % of Day":"' || CAST(slot % 100 AS VARCHAR) || '"', '') || '}' AS payload
FROM (SELECT * REPLACE (CASE WHEN slot % 10 <> 0 THEN slot END AS slot) FROM daily_lines) WHERE bad_day OR bad_total"""
ORACLES["forecast_table_round_trip"] = "SELECT * FROM route_forecast"
ORACLES["partitioned_forecast_round_trip"] = ORACLES["forecast_table_round_trip"]
ORACLES["insight_round_trip"] = "SELECT request_id, travel_minutes, density, nudge FROM messages"
ORACLES["login_report"] = """
SELECT c_custkey AS record_id, c_custkey % 9 <> 0 AS accepted, CASE WHEN c_custkey % 9 = 0 THEN 'email' ELSE '' END AS reasons FROM customer"""
ORACLES["standard_emissions"] = """
SELECT c_custkey AS rider_id, CASE WHEN c_custkey % 2 = 0 THEN 'bus' ELSE 'car' END AS mode,
       round((5 + c_custkey % 31) * CASE WHEN c_custkey % 2 = 0 THEN 2680.0::DOUBLE / 30 ELSE 404.0::DOUBLE / 1.5 END, 4) AS daily_grams
FROM customer"""
ORACLES["forecast_own_model"] = """
SELECT series_key, step, round(q10, 4) AS q10, round(q50, 4) AS q50, round(q90, 4) AS q90
FROM (SELECT series_key, min(y)::DOUBLE AS q10, avg(y)::DOUBLE AS q50, max(y)::DOUBLE AS q90 FROM payment_hours GROUP BY 1),
     (SELECT unnest(generate_series(1::BIGINT, 24::BIGINT)) AS step)"""

MENTIONED = re.compile(r"\b(" + "|".join(PARTS) + r")\b")


def _needed(sql: str, seen: dict[str, None]) -> None:
    for name in MENTIONED.findall(sql):
        if name not in seen:
            _needed(PARTS[name], seen)
            seen[name] = None


def statement(name: str) -> str:
    """Complete SQL of one twin."""
    body = ORACLES[name].strip()
    needed: dict[str, None] = {}
    _needed(body, needed)
    parts = [f"{part} AS ({PARTS[part].strip()})" for part in needed]
    if body.startswith("WITH "):
        body = body.removeprefix("WITH ")
        return "WITH " + ",\n".join([*parts, body])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
