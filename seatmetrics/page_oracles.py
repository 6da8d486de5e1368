"""DuckDB statements for the queries of ``page_queries``."""

from __future__ import annotations

from seatmetrics.ingest_oracles import key

_STAMPED = """
WITH s0 AS (SELECT event_id AS i, CAST(date_trunc('second', ts) AS TIMESTAMP) AS t, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
s1 AS (SELECT *, CASE WHEN i % 61 = 0 THEN NULL WHEN i % 4 = 0 THEN t WHEN i % 4 = 1 THEN t - INTERVAL 2 HOUR WHEN i % 4 = 2 THEN date_trunc('minute', t) END AS o, CASE WHEN i % 4 = 3 AND i % 59 <> 0 THEN t END AS c FROM s0),
s2 AS (SELECT *, CAST(CASE WHEN i % 3 = 0 THEN k END AS DOUBLE) AS con, CAST(CASE WHEN i % 3 <> 2 THEN k + 1 END AS DOUBLE) AS pk, CAST(CASE WHEN i % 7 = 0 THEN k % 4 END AS DOUBLE) AS q, CAST(CASE WHEN i % 13 = 0 THEN 2 END AS DOUBLE) AS dc FROM s1),
bad AS (SELECT i, 'invalid_date' AS rule, 'observed_at' AS field, 'later' AS value FROM s2 WHERE i % 61 = 0 UNION ALL SELECT i, 'missing_required_field', 'date', NULL FROM s2 WHERE i % 61 <> 0 AND o IS NULL AND c IS NULL),
s3 AS (SELECT *, row_number() OVER (PARTITION BY o, user_id, k % 10, q, con, pk, c ORDER BY i) AS place FROM s2 WHERE i % 61 <> 0 AND (o IS NOT NULL OR c IS NOT NULL)),
ok AS (SELECT 'feature_' || (k % 10) AS feature_id, 'user' || user_id AS u, i, CAST(coalesce(o, c) AS DATE) AS date, CAST(hour(coalesce(o, c)) AS INTEGER) AS hour, o, c, coalesce(con, pk) AS concurrent, q, dc, i % 11 = 0 AS denied FROM s3 WHERE place = 1)
"""
# Name of a scenario -> observations, percentile, growth, safety and factor of the price.
_SCENARIOS = {"defaults": (365, 0.95, "1.0", "1.1", "1.0"), "conservative": (730, 0.99, "1.1", "1.2", "1.0"), "aggressive": (365, 0.9, "1.0", "1.0", "1.0"), "raised_prices": (30, 0.99, "1.05", "1.2", "1.04")}


def _scenario(n: int, p: float, growth: str, safety: str, factor: str) -> str:
    from seatmetrics import oracles

    r, raw = oracles.r, f"b * {growth}::DOUBLE * {safety}::DOUBLE"
    last = "SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY date DESC) AS k FROM daily"
    sums = f"SELECT feature_id, entitled, unit_price * {factor}::DOUBLE AS price, count(*) AS observed_days, {oracles.q(p)} AS b, {oracles.q(0.95)} AS p95, max(peak) AS max_peak, count(*) FILTER (WHERE peak >= entitled) AS saturation_days FROM ({last}) JOIN feat USING (feature_id) WHERE k <= {n} GROUP BY ALL"
    more = f"SELECT *, {oracles.up(raw)} AS recommended, CASE WHEN entitled > 0 THEN {r('p95 / entitled * 100', 1)} ELSE 0.0::DOUBLE END AS utilization_pct, {r('saturation_days * 100.0 / observed_days', 1)} AS sat FROM ({sums})"
    risk = "CASE WHEN entitled <= 0 THEN 'Low' WHEN sat >= 10 OR utilization_pct >= 100 THEN 'Critical' WHEN utilization_pct >= 92 THEN 'High' WHEN utilization_pct >= 80 OR max_peak >= entitled THEN 'Moderate' ELSE 'Low' END"
    money = f"{r('entitled * price', 2)} AS current_cost, {r('recommended * price', 2)} AS recommended_cost, CASE WHEN price IS NOT NULL THEN {r('greatest(entitled - recommended, 0) * price', 2)} END AS opportunity, CASE WHEN price IS NOT NULL THEN {r('greatest(recommended - entitled, 0) * price', 2)} END AS incremental"
    return f"SELECT feature_id, entitled, observed_days, {r('b', 2)} AS basis, {r(raw, 4)} AS raw_recommended, recommended, max_peak, utilization_pct, saturation_days, {risk} AS risk, {money} FROM ({more})"


def _drivers(column: str, n: int) -> str:
    from seatmetrics import oracles

    whole = f"SELECT {column} AS grp, sum(total_hours) AS hours FROM act JOIN people USING (employee_id) WHERE {column} IS NOT NULL GROUP BY ALL"
    return f"SELECT grp, hours, {oracles.r('hours * 100 / total', 1)} AS share_pct FROM (SELECT *, sum(hours) OVER () AS total FROM ({whole})) ORDER BY hours DESC, grp LIMIT {n}"


_LINKS = "SELECT position_key, sum(annual_cost) AS a FROM link WHERE basis = 'unmatched' GROUP BY ALL"


def oracle_sql() -> dict[str, str]:
    from seatmetrics import ingest_oracles, oracles

    stamped = {
        "stamped_usage": "SELECT i AS source_row, date, hour, o AS observed_at, c AS checkout_at, concurrent FROM ok",
        "stamped_rejections": "SELECT rule, field, count(*) AS rejections, coalesce(max(value), '') AS examples FROM (SELECT rule, field, value FROM bad UNION ALL SELECT 'duplicate_row', NULL, NULL FROM s3 WHERE place > 1) GROUP BY rule, field",
        "stamped_concurrency": "SELECT feature_id, date, hour, max(concurrent) AS concurrent FROM ok WHERE concurrent IS NOT NULL GROUP BY ALL",
        "stamped_denials": "SELECT feature_id, date, hour, u AS \"user\", coalesce(dc, CASE WHEN denied THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS count, concurrent AS concurrent_at_denial FROM ok WHERE denied OR dc > 0",
        "stamped_activity": "SELECT feature_id, u AS \"user\", max(date) AS last_used, sum(CASE WHEN c IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(q, 0.0::DOUBLE) END) AS total_sessions FROM ok GROUP BY ALL",
    }
    core = {
        "cost_gate": "SELECT NULL::DOUBLE AS annual_spend, NULL::DOUBLE AS purchased_commitment, CAST(0 AS BIGINT) AS purchased_priced, NULL::DOUBLE AS commitment_gap, NULL::DOUBLE AS recommended_spend, NULL::DOUBLE AS opportunity, NULL::DOUBLE AS incremental, NULL::DOUBLE AS net_change, CAST(0 AS BIGINT) AS priced_features, count(*) AS unpriced_features, CAST(0 AS BIGINT) AS vendor_count, 0.0::DOUBLE AS vendor_concentration FROM feat WHERE unit_price IS NULL",
        "table_totals": f"SELECT count(*) AS features, CASE WHEN count(current_cost) > 0 THEN {oracles.r('coalesce(sum(current_cost), 0)', 2)} END AS cost, CASE WHEN count(current_cost) > 0 THEN {oracles.r('coalesce(sum(opportunity), 0)', 2)} END AS opportunity, CASE WHEN count(current_cost) > 0 THEN {oracles.r('coalesce(sum(incremental), 0)', 2)} END AS incremental FROM pf WHERE vendor_id = 'vendor:1'",
        "reconciliation_order": "SELECT feature_id, state, CASE state WHEN 'entitlement_exceeds_contract' THEN 0 WHEN 'contract_exceeds_entitlement' THEN 1 WHEN 'contract_only' THEN 2 WHEN 'entitlement_only' THEN 2 ELSE 4 END AS rank, difference_value FROM rec",
        "top_users": "SELECT employee_id, sum(total_hours) AS hours FROM act GROUP BY ALL ORDER BY hours DESC, employee_id LIMIT 8",
        "top_locations": "SELECT location, sum(total_hours) AS hours FROM act JOIN people USING (employee_id) GROUP BY ALL ORDER BY hours DESC, location LIMIT 6",
        "top_forecasts": f"SELECT feature_id, financial_impact FROM (SELECT feature_id, {oracles.r('(rec - entitled) * unit_price', 2)} AS financial_impact FROM (SELECT feature_id, entitled, unit_price, {oracles.up(oracles.r('p95 * (1 + growth)', 2) + ' * 1.1')} AS rec FROM fc) WHERE unit_price IS NOT NULL) ORDER BY abs(financial_impact) DESC, feature_id LIMIT 5",
        **{f"scenario_{name}": _scenario(*values) for name, values in _SCENARIOS.items()},
        "drivers_by_person": _drivers("username", 5),
        "drivers_by_department": _drivers("department", 4),
        "spend_shares": f"SELECT vendor_id, spend, {oracles.r('spend * 100 / nullif(sum(spend) OVER (), 0)', 1)} AS share_pct FROM (SELECT vendor_id, {oracles.r('coalesce(sum(current_cost), 0)', 2)} AS spend FROM pf GROUP BY ALL)",
        "positions_order": "SELECT feature_id, renewal_date, current_cost FROM pf",
        "open_decisions": "SELECT id, CASE kind WHEN 'renewal' THEN 'negotiate' WHEN 'capacity' THEN 'increase' WHEN 'cost' THEN 'reduce' WHEN 'reclaim' THEN 'reclaim' WHEN 'usage' THEN 'review' WHEN 'forecast' THEN 'increase' WHEN 'data' THEN 'resolve' ELSE 'reconcile' END AS action FROM sig WHERE id NOT IN ('renewal:contract:1', 'cost:Brand#1')",
        "portfolio_export": "SELECT feature_id, feature_name, vendor_name, license_model, entitled, recommended, current_cost, opportunity, risk, confidence FROM pf",
        "renewals_export": "SELECT contract_id, vendor_name, renewal_date, days_to_renewal, current_spend, recommended_spend FROM ren",
        "reclaim_export": "SELECT feature_id, employee_id, display_name, department, last_used, CAST(idle AS INTEGER) AS idle_days, unit_price AS annual_value FROM idle JOIN feat USING (feature_id) LEFT JOIN people USING (employee_id) WHERE cand AND license_model IN ('named_user', 'subscription')",
        "kept_projection": f"SELECT *, TRUE AS usable FROM ({oracles._TOTALS})",
    }
    ingest = {
        "identity_order": f"SELECT {key('feature')} AS feature_key, count(*) AS observations FROM ln GROUP BY ALL",
        "review_totals": f"SELECT count(*) AS positions, {oracles.r('coalesce(sum(v), 0)', 2)} AS excluded_value, count(*) FILTER (WHERE v IS NULL) AS unpriced_positions FROM (SELECT {oracles.r('a', 2)} AS v FROM ({_LINKS}))",
        "user_totals": "SELECT status, count(*) AS users, CAST(sum(observations) AS BIGINT) AS observations FROM users GROUP BY ALL",
    }
    words = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: length(w) >= 3)"
    plain = {
        "unmapped_suggestions": f"SELECT raw, feature_id, CAST(overlap AS BIGINT) AS overlap FROM (SELECT raw, feature_id, overlap, row_number() OVER (PARTITION BY raw ORDER BY overlap DESC, feature_id) AS k FROM (SELECT raw, feature_id, len(list_filter({words.format('raw')}, lambda w: list_contains({words.format('label')}, w))) AS overlap FROM (SELECT DISTINCT p_name || '-TOOL' AS raw FROM part), (SELECT 'feature:' || min(p_partkey) AS feature_id, p_name AS label FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_name)) WHERE overlap > 0) WHERE k = 1",
        "related_by_lead": f"WITH n AS (SELECT DISTINCT {key('p_name')} AS f FROM part), l AS (SELECT f, list_filter(string_split(f, '_'), lambda w: length(w) >= 3)[1] AS lead FROM n), p AS (SELECT a.f, a.lead, list(b.f ORDER BY b.f) AS others FROM l a JOIN l b ON a.lead = b.lead AND a.f <> b.f GROUP BY ALL) SELECT f AS feature_key, lead, CAST(len(others) AS BIGINT) AS others, array_to_string(others[1:5], '|') AS related FROM p",
        "date_range": "SELECT o_orderstatus, CAST(unnest(range(f, f + INTERVAL 30 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT o_orderstatus, CAST(min(o_orderdate) AS DATE) AS f FROM orders GROUP BY ALL)",
        "identity_sources": f"SELECT {key('p_name')} AS feature_key, count(*) FILTER (WHERE p_partkey % 4 <> 0) AS usage, count(*) FILTER (WHERE p_partkey % 4 <> 1) AS entitlements, count(*) FILTER (WHERE p_partkey % 4 <> 2) AS contracts FROM part GROUP BY ALL",
        "observed_keys": f"SELECT DISTINCT {key('p_name')} AS feature_key FROM part",
        "licence_models": f"SELECT position_key, min(m) AS license_model FROM (SELECT {key('p_name')} AS position_key, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 AND length(p_name) % 2 = 0 THEN 'token' ELSE 'named_user' END AS m FROM part) GROUP BY ALL HAVING count(DISTINCT m) = 1",
        "last_items": "SELECT p_brand AS feature_id, max(p_partkey) AS source_row, max_by(p_size, p_partkey) AS p_size FROM part GROUP BY ALL",
        "evidence_state": "SELECT * FROM (VALUES ('same', TRUE), ('more imports', FALSE), ('other rows', FALSE), ('more confirmations', FALSE)) t(state, equal)",
        "import_commit": "SELECT CASE p_partkey % 2 WHEN 0 THEN 'one' ELSE 'two' END AS import_id, count(*) AS rows, CAST(sum(p_size) AS BIGINT) AS quantity FROM part GROUP BY ALL",
    }
    return {k: _STAMPED + v for k, v in stamped.items()} | {k: oracles.sql(v) for k, v in core.items()} | {k: ingest_oracles.sql(v) for k, v in ingest.items()} | plain
