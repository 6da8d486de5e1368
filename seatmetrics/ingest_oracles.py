"""DuckDB statements for the queries of ingestion, identity and review."""

from __future__ import annotations


def r(x: str, places: int = 0) -> str:
    return f"(floor(CAST({x} AS DOUBLE) * {10**places}.0 + 0.5) / {10**places}.0)"


def key(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '[\\s\\-.]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"


def sku(x: str) -> str:
    return f"regexp_replace(lower({x}), '[\\s\\-_./]', '', 'g')"


_RAW = "SELECT event_id AS source_row, CASE WHEN event_id % 97 = 0 THEN 'soon' WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 3 = 1 THEN strftime(ts, '%m/%d/%Y') ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS date, CASE WHEN event_id % 73 = 0 THEN '42' WHEN event_id % 2 = 0 THEN strftime(ts, '%H:%M') ELSE CAST(hour(ts) AS VARCHAR) END AS hour, CASE WHEN event_id % 89 = 0 THEN ' ' ELSE CASE WHEN event_id % 2 = 0 THEN 'Feature ' ELSE 'feature-' END || (k % 10) END AS feature, ' User' || user_id AS usr, CASE WHEN event_id % 83 = 0 THEN '-4' WHEN event_id % 79 = 0 THEN 'many' ELSE '1,' || lpad(CAST(k AS VARCHAR), 3, '0') END AS concurrent, CASE event_id % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE 'perhaps' END AS denied FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
CTE = {
    "raw": f"SELECT * FROM ({_RAW}) UNION ALL SELECT source_row + 1000000000000, date, hour, feature, usr, concurrent, denied FROM ({_RAW}) WHERE source_row % 50 = 0",
    "cells": "SELECT source_row, date AS date_text, hour AS hour_text, concurrent AS number_text, CASE WHEN date LIKE '__/__/____' THEN CAST(strptime(date, '%m/%d/%Y') AS DATE) WHEN date LIKE '____-__-__%' THEN CAST(substr(date, 1, 10) AS DATE) END AS date, CASE WHEN CAST(split_part(hour, ':', 1) AS INTEGER) BETWEEN 0 AND 23 THEN CAST(split_part(hour, ':', 1) AS INTEGER) END AS hour, nullif(trim(feature), '') AS feature, trim(usr) AS usr, try_cast(replace(concurrent, ',', '') AS DOUBLE) AS concurrent, CASE denied WHEN 'Yes' THEN TRUE WHEN 'no' THEN FALSE END AS denied FROM raw",
    "ok0": "SELECT * FROM cells WHERE date IS NOT NULL AND hour IS NOT NULL AND feature IS NOT NULL AND concurrent >= 0",
    "ok": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, hour, lower(usr), lower(feature), concurrent ORDER BY source_row) AS place FROM ok0)",
    "rej": "SELECT source_row, 'invalid_date' AS rule, 'date' AS field, date_text AS value FROM cells WHERE date IS NULL UNION ALL SELECT source_row, 'invalid_hour', 'hour', hour_text FROM cells WHERE hour IS NULL UNION ALL SELECT source_row, 'missing_required_field', 'feature', NULL FROM cells WHERE feature IS NULL UNION ALL SELECT source_row, 'invalid_number', 'concurrent', number_text FROM cells WHERE concurrent IS NULL UNION ALL SELECT source_row, 'negative_quantity', 'concurrent', number_text FROM cells WHERE concurrent < 0 UNION ALL SELECT source_row, 'duplicate_row', NULL, NULL FROM ok WHERE place > 1",
    "ln": "SELECT id AS line_id, CASE WHEN id % 4 = 0 THEN 'Suite ' || p_name WHEN id % 4 = 1 THEN upper(p_name) ELSE p_name END AS feature, CASE WHEN id % 7 <> 0 THEN 'SKU-' || substr(p_brand, 7) || '.' || length(p_name) END AS sku, CASE WHEN id % 5 <> 0 THEN l_quantity END AS quantity, CASE WHEN id % 3 <> 0 THEN l_quantity * 3 + 1.25 END AS unit_price, CASE WHEN id % 2 <> 0 THEN floor(l_extendedprice) END AS total_cost, CASE WHEN id % 4 <> 3 THEN floor(l_extendedprice) * 0.5 END AS annual_cost, CASE WHEN id % 6 = 0 THEN 'EUR' WHEN id % 6 <> 5 THEN 'USD' END AS currency, CAST(id % 9 * 100 AS INTEGER) AS days, CAST(l_shipdate AS DATE) AS start_date, 'C' || (id % 7) AS contract_number, lower(p_brand) AS vendor FROM (SELECT *, l_orderkey * 10 + l_linenumber AS id FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "cost": f"SELECT * EXCLUDE (unit_price, annual_cost), my AS multi_year, CASE WHEN unit_price IS NOT NULL THEN {r('unit_price', 2)} WHEN annual_cost IS NOT NULL AND quantity > 0 THEN {r('annual_cost / quantity', 2)} WHEN total_cost IS NOT NULL AND quantity > 0 AND NOT my THEN {r('total_cost / quantity', 2)} END AS unit_price, CASE WHEN unit_price IS NOT NULL THEN 'supplied_unit_price' WHEN annual_cost IS NOT NULL AND quantity > 0 THEN 'total_over_quantity' WHEN total_cost IS NOT NULL AND quantity > 0 AND NOT my THEN 'total_over_quantity' ELSE 'none' END AS unit_price_basis, CASE WHEN annual_cost IS NOT NULL THEN {r('annual_cost', 2)} WHEN unit_price IS NOT NULL AND quantity > 0 THEN {r('unit_price * quantity', 2)} WHEN total_cost IS NOT NULL AND NOT my THEN {r('total_cost', 2)} END AS annual_cost, CASE WHEN annual_cost IS NOT NULL THEN 'supplied_annual_cost' WHEN unit_price IS NOT NULL AND quantity > 0 THEN 'quantity_x_unit' WHEN total_cost IS NOT NULL AND NOT my THEN 'supplied_total_cost' ELSE 'none' END AS annual_cost_basis FROM (SELECT *, days > 400 AND total_cost IS NOT NULL AS my FROM ln)",
    "known": f"SELECT DISTINCT {key('p_name')} AS k FROM part WHERE p_partkey % 3 <> 0 AND {key('p_name')} NOT LIKE '%gear'",
    "vouch": f"SELECT {sku('sku')} AS s, max_by({key('feature')}, line_id) AS v FROM ln JOIN known ON k = {key('feature')} WHERE sku IS NOT NULL GROUP BY 1",
    "link": f"SELECT cost.*, CASE WHEN al THEN 'confirmed_alias' WHEN k IS NOT NULL THEN 'normalized_name' WHEN v IS NOT NULL THEN 'sku' ELSE 'unmatched' END AS basis, CASE WHEN al THEN 'red_widget' WHEN k IS NOT NULL THEN k ELSE v END AS feature_key, coalesce(CASE WHEN al THEN 'red_widget' WHEN k IS NOT NULL THEN k ELSE v END, {key('feature')}) AS position_key FROM (SELECT *, lower(trim(feature)) = 'suite red widget' AND EXISTS (SELECT 1 FROM known WHERE k = 'red_widget') AS al FROM cost) cost LEFT JOIN known ON k = {key('feature')} LEFT JOIN vouch ON s = {sku('sku')}",
    "ev": "SELECT lower(trim(CASE WHEN user_id % 7 = 3 THEN 'USER' || user_id WHEN user_id % 7 = 5 THEN 'svc_' || user_id WHEN user_id % 7 = 6 THEN 'user' || (user_id + 3) || '@example.com' ELSE ' user' || user_id END)) AS key, CASE WHEN user_id % 7 = 5 AND event_id % 4 = 0 AND user_id % 2 = 0 THEN 'e' || lpad(CAST(user_id AS VARCHAR), 6, '0') END AS code, event_id FROM events",
    "ppl": "SELECT c_custkey AS id, CASE WHEN c_custkey % 40 = 1 THEN 'user2' ELSE 'user' || c_custkey END AS name, 'e' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, 'user' || (c_custkey + 3) || '@example.com' AS mail FROM customer",
    "byname": "SELECT name AS key, count(*) AS n, min(id) AS p FROM ppl GROUP BY ALL",
    "steps": "SELECT ev.key, ev.event_id, CASE WHEN cf.p IS NOT NULL THEN 'confirmed' WHEN a.n > 0 THEN 'username' WHEN b.id IS NOT NULL THEN 'code' WHEN c.id IS NOT NULL THEN 'email' END AS basis, CASE WHEN cf.p IS NOT NULL THEN 1 WHEN a.n > 0 THEN a.n WHEN b.id IS NOT NULL OR c.id IS NOT NULL THEN 1 END AS n, CASE WHEN cf.p IS NOT NULL THEN cf.p WHEN a.n > 0 THEN a.p WHEN b.id IS NOT NULL THEN b.id ELSE c.id END AS p FROM ev LEFT JOIN byname a ON a.key = ev.key LEFT JOIN ppl b ON b.code = ev.code LEFT JOIN ppl c ON c.mail = ev.key LEFT JOIN (SELECT 'svc_5' AS key, p FROM byname WHERE key = 'user9') cf ON cf.key = ev.key",
    "users": "SELECT key, observations, CASE WHEN basis IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' WHEN basis = 'confirmed' THEN 'confirmed' ELSE 'matched' END AS status, CASE WHEN n = 1 THEN basis END AS basis, CASE WHEN n = 1 THEN p END AS person_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN n = 1 THEN 0 WHEN n > 1 THEN 1 ELSE 2 END, event_id) AS k, count(*) OVER (PARTITION BY key) AS observations FROM steps) WHERE k = 1",
    "ld": "SELECT CAST(max(l_shipdate) AS DATE) AS d1 FROM lineitem",
    "craw": "SELECT o_orderkey AS i, ['USD', '$', '€', 'zz', ' ', 'GBP 5'][o_orderkey % 6 + 1] AS currency, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderdate AS DATE) + CAST((o_orderkey % 7 - 1) * 100 AS INTEGER) END AS e FROM orders",
    "nm": "SELECT DISTINCT p_name AS name, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'for', 'license', 'licence', 'software', 'suite', 'product', 'feature', 'module')))) AS tok FROM part",
}


def sql(select: str) -> str:
    import re

    needed: set[str] = set()
    todo = [select]
    while todo:
        part = todo.pop()
        for name in CTE:
            if name not in needed and re.search(rf"\b{name}\b", part):
                needed.add(name)
                todo.append(CTE[name])
    parts = ", ".join(f"{n} AS ({CTE[n]})" for n in CTE if n in needed)
    return f"WITH {parts} {select}" if parts else select


_CAPS = {
    "usageTrends": (True, ""),
    "dailyDemand": (True, ""),
    "percentileDemand": (True, ""),
    "capacityHeadroom": (True, ""),
    "utilization": (True, ""),
    "denialAnalysis": (True, ""),
    "financialOpportunity": (False, "cost"),
    "recommendedRenewalSpend": (False, "cost"),
    "renewalExposure": (False, "contractDates"),
    "reclaimOpportunity": (False, "namedUser and cost"),
    "organizationAllocation": (True, ""),
}


def oracle_sql() -> dict[str, str]:
    cover = " UNION ALL ".join(f"SELECT '{f}' AS field, count({c}) AS present, count(*) AS n FROM ok WHERE place = 1" for f, c in (("date", "date"), ("hour", "hour"), ("feature", "feature"), ("user", "usr"), ("concurrent", "concurrent"), ("denied", "denied")))
    name_of = "CASE WHEN p_partkey % 5 = 0 THEN '=SUM(' || p_name || ')' WHEN p_partkey % 5 = 1 THEN p_name || ', \"quoted\"' ELSE p_name END"
    title = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' - ' || p_brand"
    worst = "['Low', 'Moderate', 'High', 'Critical'][greatest(CASE WHEN n > 4 THEN 3 ELSE 1 END, CASE WHEN m > 5 THEN 4 ELSE 1 END, 2)]"
    out = {
        "normalize_usage": "SELECT source_row, date, hour, feature, usr AS \"user\", concurrent, denied FROM ok WHERE place = 1",
        "rejections": "SELECT * FROM rej",
        "rejection_summary": "SELECT rule, field, count(*) AS rejections, coalesce(array_to_string(list_sort(list(DISTINCT value) FILTER (WHERE value IS NOT NULL))[1:3], '|'), '') AS examples FROM rej GROUP BY rule, field",
        "field_quality": f"SELECT field, present, {r('present * 100.0 / n', 1)} AS coverage_pct, {r('80 * 0.3 + n * 40.0 / (SELECT count(*) FROM raw) + 30', 1)} AS confidence FROM ({cover})",
        "derive_cost": "SELECT line_id, unit_price, unit_price_basis, annual_cost, annual_cost_basis, multi_year FROM cost",
        "link_contracts": "SELECT line_id, basis, feature_key, position_key FROM link",
        "merge_positions": f"SELECT position_key, lines, quantity, annual_cost, CASE WHEN annual_cost IS NOT NULL AND quantity > 0 THEN {r('a / quantity', 2)} WHEN w > 0 THEN {r('v / w', 2)} WHEN np = 1 THEN p END AS unit_price, CASE WHEN nc = 1 THEN c END AS currency, renewal_date, contract_numbers FROM (SELECT position_key, count(*) AS lines, sum(coalesce(quantity, 0)) AS quantity, sum(annual_cost) AS a, {r('sum(annual_cost)', 2)} AS annual_cost, sum(unit_price * quantity) FILTER (WHERE quantity > 0) AS v, sum(quantity) FILTER (WHERE unit_price IS NOT NULL AND quantity > 0) AS w, count(DISTINCT unit_price) AS np, min(unit_price) AS p, count(DISTINCT currency) AS nc, min(currency) AS c, min(start_date + days + 30) AS renewal_date, string_agg(DISTINCT contract_number, ',' ORDER BY contract_number) AS contract_numbers FROM link GROUP BY ALL)",
        "contract_review": f"SELECT position_key, count(*) AS occurrences, {r('coalesce(sum(annual_cost), 0)', 2)} AS annual_cost FROM link WHERE basis = 'unmatched' GROUP BY ALL",
        "feature_identity": f"SELECT a.k AS feature_key, observations, spellings, common_feature, common_vendor FROM (SELECT {key('feature')} AS k, count(*) AS observations, string_agg(DISTINCT feature, '|' ORDER BY feature) AS spellings FROM ln GROUP BY ALL) a JOIN (SELECT k, feature AS common_feature FROM (SELECT {key('feature')} AS k, feature, row_number() OVER (PARTITION BY {key('feature')} ORDER BY count(*) DESC, feature) AS p FROM ln GROUP BY k, feature) WHERE p = 1) b ON a.k = b.k JOIN (SELECT k, vendor AS common_vendor FROM (SELECT {key('feature')} AS k, vendor, row_number() OVER (PARTITION BY {key('feature')} ORDER BY count(*) DESC, vendor) AS p FROM ln GROUP BY k, vendor) WHERE p = 1) c ON a.k = c.k",
        "resolve_users": "SELECT * FROM users",
        "unmatched_users": "SELECT key, observations, status FROM users WHERE status IN ('unmatched', 'ambiguous')",
        "people_without_usage": "SELECT c_custkey AS person_id, 'user' || c_custkey AS username FROM customer WHERE c_custkey NOT IN (SELECT person_id FROM users WHERE person_id IS NOT NULL)",
        "review_queue": "SELECT 'l:' || a AS line_id, 'f:' || b AS feature_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, 'f:' || b) AS rank FROM (SELECT x.name AS a, y.name AS b, CAST(least(100, floor(100.0 * len(list_intersect(x.tok, y.tok)) / len(list_distinct(list_concat(x.tok, y.tok))) + 0.5) + CASE WHEN length(y.name) % 3 = 1 THEN 15 ELSE 0 END) AS BIGINT) AS score FROM nm x, nm y WHERE len(list_intersect(x.tok, y.tok)) > 0) WHERE score >= 15) WHERE rank <= 5",
        "user_review_queue": "SELECT key, employee_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, employee_id) AS rank FROM (SELECT key, employee_id, CAST(max(greatest(s - less, 0)) AS BIGINT) AS score FROM (SELECT key, employee_id, less, CASE WHEN key = id THEN 95 WHEN ends_with(id, key) THEN 70 WHEN ends_with(key, id) THEN 60 WHEN starts_with(id, key) OR starts_with(key, id) THEN 55 ELSE 0 END AS s FROM (SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') || CASE WHEN c_custkey % 3 = 0 THEN '@a' ELSE '@b' END AS key FROM customer), (SELECT c_custkey AS employee_id, 'u' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '@a' AS id, 0 AS less FROM customer UNION ALL SELECT c_custkey, lpad(CAST(c_custkey + 3 AS VARCHAR), 6, '0'), 10 FROM customer)) WHERE s > 0 GROUP BY ALL)) WHERE rank <= 5 AND score > 0",
        "related_features": f"SELECT name, feature_key, CAST(rank AS INTEGER) AS rank FROM (SELECT name, feature_key, row_number() OVER (PARTITION BY name ORDER BY feature_key) AS rank FROM (SELECT DISTINCT a.k AS name, b.k AS feature_key FROM (SELECT DISTINCT {key('p_name')} AS k FROM part) a, (SELECT DISTINCT {key('p_name')} AS k FROM part) b WHERE a.k <> b.k AND len(list_intersect(list_filter(string_split(a.k, '_'), lambda w: length(w) >= 4), string_split(b.k, '_'))) > 0)) WHERE rank <= 5",
        "capabilities": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(a).upper()}, '{n}')" for k, (a, n) in _CAPS.items()) + ") t(capability, available, requires)",
        "integrity": "SELECT 'usage' AS dataset, n AS accepted, n AS stored, n AS analysed, TRUE AS intact FROM (SELECT count(*) AS n FROM ok WHERE place = 1)",
        "evidence_key": "SELECT 'v1|' || count(*) || '|' || count(DISTINCT o_orderpriority) AS evidence_key, TRUE AS short FROM orders",
        "fingerprint": "SELECT p_partkey AS import_id, sha256(sha256(p_name) || '|usage|date=' || p_type || ',user=' || p_brand) AS fingerprint FROM part",
        "export_csv": f"SELECT p_partkey, CASE WHEN s LIKE '%\"%' OR s LIKE '%,%' THEN '\"' || replace(s, '\"', '\"\"') || '\"' ELSE s END || ',' || p_size AS line FROM (SELECT *, CASE WHEN x LIKE '=%' THEN '''' || x ELSE x END AS s FROM (SELECT p_partkey, p_size, {name_of} AS x FROM part))",
        "coverage_lines": f"SELECT count(*) AS rows, count(DISTINCT {key('feature')}) AS features, count(DISTINCT lower(usr)) AS users, min(date) AS first_date, max(date) AS last_date, bool_or(concurrent IS NOT NULL) AS has_concurrency, bool_or(denied) AS has_denials, FALSE AS has_durations, CAST(max(date) - min(date) + 1 AS BIGINT) AS history_days FROM ok WHERE place = 1",
        "date_helpers": "SELECT d AS day, CAST(d - DATE '1970-01-01' AS BIGINT) AS epoch_day, CAST(dayofweek(d) AS BIGINT) AS weekday, dayofweek(d) IN (0, 6) AS weekend, strftime(d, '%-d %b %Y') AS day_text, strftime(d, '%Y-%m') AS month, CAST(greatest(e - d, 0) AS BIGINT) AS idle, d BETWEEN e - 181 AND e AS in_window FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), (SELECT CAST(max(l_shipdate) AS DATE) AS e FROM lineitem)",
        "text_parsers": f"SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 1000 + p_size + 0.5 WHEN p_partkey % 4 <> 1 THEN CAST(p_size AS DOUBLE) END::DOUBLE AS number, CASE WHEN p_partkey % 3 = 0 THEN try_cast('2024-' || p_size || '-' || (p_partkey % 14) AS DATE) END AS month_first, CASE WHEN p_partkey % 3 = 0 THEN try_cast('2024-' || (p_partkey % 14) || '-' || p_size AS DATE) END AS day_first, ['USD', 'EUR', NULL, NULL, 'GBP'][p_partkey % 5 + 1] AS currency, p_partkey % 5 = 2 AS unreadable, ['concurrent', 'named_user', 'node_locked', 'token', 'unknown'][p_partkey % 5 + 1] AS licence_model, {key(title)} AS feature_key, {sku(title)} AS sku_key, regexp_replace(regexp_replace(lower({title}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower({title}), '[^a-z0-9]+'), lambda w: length(w) >= 3))), ' ') AS tokens FROM part",
        "stats_scalars": f"SELECT l_orderkey, {r('q * 1.1::DOUBLE', 1)} AS rounded, {r('-q / 2')} AS half, CAST(ceil(round(q * 1.1::DOUBLE, 9)) AS BIGINT) AS up, q / nullif(n - 3, 0) AS ratio, greatest(20.0::DOUBLE, least(200.0::DOUBLE, q * 1.1::DOUBLE)) AS clamped, CASE WHEN q > 0 THEN {r('n / q * 100', 1)} ELSE 0.0 END AS share, {worst} AS worst, CASE WHEN n > 2 THEN '$' || format('{{:,}}', CAST(q AS BIGINT)) ELSE '—' END AS money FROM (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n, max(l_linenumber) AS m FROM lineitem GROUP BY ALL)",
    }
    shape = "0.05, 0.05, 0.05, 0.05, 0.05, 0.1, 0.2, 0.45, 0.7, 0.9, 1.0, 0.95, 0.8, 0.9, 1.0, 0.95, 0.85, 0.6, 0.4, 0.25, 0.15, 0.1, 0.08, 0.05"
    out["licence_hours"] = f"SELECT feature_id, day, CAST(sum(floor(peak * CAST(part AS DOUBLE) + 0.5)) AS BIGINT) AS licence_hours FROM (SELECT p_brand AS feature_id, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS peak FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#7' GROUP BY ALL), (SELECT unnest([{shape}]) AS part), (SELECT CAST(max(l_shipdate) AS DATE) AS e FROM lineitem) WHERE day BETWEEN e - 89 AND e GROUP BY ALL"
    out["stream_hourly_concurrency"] = "SELECT 'f' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 10) AS feature_id, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, CAST(max(CAST(floor(value) AS INTEGER)) AS DOUBLE) AS concurrent FROM events WHERE event_type <> 'view' GROUP BY ALL"
    out["normalize_contracts"] = "SELECT rule, field, count(*) AS rejections, coalesce(array_to_string(list_sort(list(DISTINCT value) FILTER (WHERE value IS NOT NULL))[1:3], '|'), '') AS examples FROM (SELECT 'invalid_currency' AS rule, 'currency' AS field, currency AS value FROM craw WHERE currency IN ('$', 'zz') UNION ALL SELECT 'inconsistent_dates', 'end_date', CAST(e AS VARCHAR) FROM craw WHERE e < s UNION ALL SELECT 'no_commercial_content', NULL, NULL FROM craw WHERE i % 4 NOT IN (1, 2) AND e IS NULL) GROUP BY ALL"
    out["accepted_contracts"] = "SELECT i AS source_row, 'Line ' || i AS feature, CASE WHEN i % 3 <> 0 THEN 5.0::DOUBLE END AS quantity, CASE WHEN i % 4 = 1 THEN 1000.5::DOUBLE END AS unit_price, CASE WHEN i % 4 = 2 THEN 900.0::DOUBLE END AS total_cost, CASE i % 6 WHEN 0 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 5 THEN 'GBP' END AS currency, s AS start_date, e AS end_date FROM craw WHERE currency NOT IN ('$', 'zz') AND (e IS NULL OR e >= s) AND (i % 4 IN (1, 2) OR e IS NOT NULL)"
    out["assembled_features"] = f"SELECT k AS feature_key, CAST(coalesce(q, b, 0) AS BIGINT) AS entitled, coalesce(CASE WHEN m = 'node_locked' THEN 'custom' WHEN m <> 'unknown' THEN m END, bm, 'concurrent') AS license_model, unit_price, coalesce(rd, x) AS renewal_date, q IS NOT NULL AND b IS NOT NULL AS both_sources FROM (SELECT DISTINCT {key('p_name')} AS k FROM part) LEFT JOIN (SELECT {key('p_name')} AS k, p_size AS q, CASE p_partkey % 4 WHEN 0 THEN 'node_locked' WHEN 1 THEN 'unknown' ELSE 'named_user' END AS m, d1 + CAST(p_partkey % 50 AS INTEGER) AS x, row_number() OVER (PARTITION BY {key('p_name')} ORDER BY p_size DESC, p_partkey) AS n FROM part, ld WHERE p_partkey % 3 <> 0) s USING (k) LEFT JOIN (SELECT {key('p_name')} AS k, sum(p_size) AS b, max(p_retailprice) AS unit_price, CASE WHEN min(p_partkey) % 2 = 0 THEN 'token' END AS bm, max(d1) + CAST(min(p_partkey) % 90 AS INTEGER) AS rd FROM part, ld WHERE p_name LIKE '%ring' OR p_name LIKE 'blue%' GROUP BY ALL) USING (k) WHERE n IS NULL OR n = 1"
    out["alias_map"] = "SELECT 'raw ' || g AS raw, 'mech_ent_' || i AS target FROM (SELECT c_custkey % 20 AS g, max(c_custkey) AS i FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL) WHERE i % 7 <> 0"
    out["people_wording"] = "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 IN (0, 2, 3) THEN 'contractor' ELSE 'employee' END AS employee_type, CASE WHEN c_custkey % 6 IN (1, 2, 4, 5) THEN 'inactive' ELSE 'active' END AS status, c_custkey % 3 = 0 AS service, CASE c_custkey % 3 WHEN 0 THEN 'svc' WHEN 1 THEN 'ann' ELSE 'bob' END AS bare FROM customer"
    core = {
        "evidence_record": "SELECT feature_id, CAST(row_number() OVER (PARTITION BY feature_id ORDER BY k) - 1 AS INTEGER) AS place, label, value FROM (SELECT feature_id, unnest(range(7)) AS k, unnest(['Licence model', 'Observed days', 'P95 demand', 'Entitled', 'Recommended', 'Risk', 'Confidence']) AS label, unnest([license_model, CAST(observed_days AS VARCHAR), CAST(CAST(trunc(p95) AS BIGINT) AS VARCHAR), CAST(entitled AS VARCHAR), CASE WHEN sized THEN CAST(recommended AS VARCHAR) END, risk, confidence]) AS value FROM pf) WHERE value IS NOT NULL",
        "page_figures": f"SELECT at_risk, reclaim_features, CAST(seats AS BIGINT) AS seats, decision_impact, spend_90, exposed, lapsed, d1 AS as_of FROM (SELECT count(*) FILTER (WHERE risk IN ('High', 'Critical')) AS at_risk, count(*) FILTER (WHERE reclaim_candidates > 0) AS reclaim_features, sum(reclaim_candidates) AS seats, {r('coalesce(sum(abs(coalesce(opportunity, 0) - coalesce(incremental, 0))), 0)', 2)} AS decision_impact FROM pf), (SELECT {r('coalesce(sum(CASE WHEN days_to_renewal BETWEEN 0 AND 90 THEN current_spend END), 0)', 2)} AS spend_90, count(*) FILTER (WHERE capacity_exposure > 0) AS exposed, count(*) FILTER (WHERE days_to_renewal < 0) AS lapsed FROM ren), win",
        "agreement_drivers": f"SELECT grp, hours, {r('hours * 100 / sum(hours) OVER ()', 1)} AS share_pct FROM (SELECT people.region AS grp, sum(total_hours) AS hours FROM act JOIN feat USING (feature_id) JOIN people USING (employee_id) WHERE contract_id = 'contract:2' AND people.region IS NOT NULL GROUP BY ALL)",
        "user_export": "SELECT feature_id, employee_id, assigned, total_sessions, total_hours, last_used, display_name, department, location, feature_name, license_model FROM act LEFT JOIN people USING (employee_id) LEFT JOIN feat USING (feature_id)",
        "last_observations": "SELECT feature_id, count(*) AS observations, round(quantile_cont(peak, 0.95), 6) AS p95, min(date) AS first_date FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY date DESC) AS k FROM daily) WHERE k <= 30 GROUP BY ALL",
    }
    from seatmetrics import oracles

    return {k: sql(v) for k, v in out.items()} | {k: oracles.sql(v) for k, v in core.items()}
