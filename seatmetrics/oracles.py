"""DuckDB statements for the registered queries, written on their own from the rules."""

from __future__ import annotations


def r(x: str, places: int = 0) -> str:
    return f"(floor(CAST({x} AS DOUBLE) * {10**places}.0 + 0.5) / {10**places}.0)"


def up(x: str) -> str:
    return f"CAST(ceil(round(CAST({x} AS DOUBLE), 9)) AS BIGINT)"


def q(p: float, x: str = "peak") -> str:
    return f"round(quantile_cont({x}, {p}), 6)"


_MODEL = "CASE n % 5 WHEN 0 THEN 'token' WHEN 1 THEN 'concurrent' WHEN 2 THEN 'concurrent' WHEN 3 THEN 'named_user' ELSE 'subscription' END"
#: Named subqueries; each may use those before it.
CTE = {
    "usage": "SELECT 'f' || (k % 10) AS feature_id, 'User' || user_id AS usr, user_id AS employee_id, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, CASE WHEN event_type <> 'view' THEN CAST(floor(value) AS INTEGER) END AS concurrent, CASE WHEN event_type <> 'error' THEN floor(value) / 4.0 END AS duration_hours, event_type = 'error' AS denied, k AS tokens, event_id FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)",
    "hourly": "SELECT feature_id, date, hour, CAST(max(concurrent) AS DOUBLE) AS concurrent FROM usage WHERE concurrent IS NOT NULL AND hour IS NOT NULL GROUP BY ALL",
    "short_daily": "SELECT feature_id, date, max(concurrent) AS peak FROM hourly GROUP BY ALL",
    "short_win": "SELECT max(date) AS d1, max(date) - 89 AS d0 FROM usage",
    "short_ent": "SELECT 'f' || (p_partkey % 10) AS feature_id, CAST(max(p_size) AS BIGINT) AS entitled, max(p_retailprice) AS unit_price FROM part GROUP BY ALL",
    "short_tokens": "SELECT feature_id, date, CAST(sum(tokens) AS DOUBLE) AS token_hours, max(tokens) AS peak_tokens FROM usage GROUP BY ALL",
    "win": "SELECT CAST(max(l_shipdate) AS DATE) AS d1, CAST(max(l_shipdate) AS DATE) - 364 AS d0 FROM lineitem",
    "feat0": "SELECT p_brand AS feature_id, CAST(substr(p_brand, 7) AS INTEGER) AS n, sum(p_size) AS size, max(p_retailprice) AS price FROM part GROUP BY ALL",
    "feat": f"SELECT feature_id, 'Feature ' || n AS feature_name, 'product:' || n AS product_id, 'vendor:' || (n % 4) AS vendor_id, 'Vendor ' || (n % 4) AS vendor_name, {_MODEL} AS license_model, served AS served_quantity, bought AS purchased_quantity, coalesce(served, bought, 0) AS entitled, CASE WHEN n NOT IN (6, 13) THEN price END AS unit_price, CASE WHEN n <> 14 THEN 'contract:' || (n % 4) END AS contract_id, CASE WHEN n <> 14 THEN d1 + (n % 4) * 45 - 20 END AS renewal_date FROM (SELECT *, CASE WHEN n <> 11 THEN CAST(size // 20 AS BIGINT) END AS served, CASE WHEN n = 12 THEN NULL WHEN n % 3 = 0 THEN CAST(size // 20 AS BIGINT) ELSE CAST(size // 18 AS BIGINT) END AS bought FROM feat0), win",
    "line": "SELECT p_brand AS feature_id, lineitem.* FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#7'",
    "daily": "SELECT feature_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS peak, max(l_quantity) AS peak_tokens FROM line GROUP BY ALL",
    "act0": "SELECT feature_id, o_custkey AS employee_id, count(DISTINCT l_orderkey) AS s, sum(l_quantity) AS h, max(CAST(o_orderdate AS DATE)) AS d FROM line JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
    "act": "SELECT feature_id, employee_id, employee_id % 17 <> 0 AS assigned, CASE WHEN employee_id % 50 = 0 THEN 0 ELSE s END AS total_sessions, CASE WHEN employee_id % 50 = 0 THEN 0.0 ELSE h END AS total_hours, CASE WHEN employee_id % 50 <> 0 THEN d END AS last_used FROM act0",
    "people": "SELECT c_custkey AS employee_id, 'user' || c_custkey AS username, c_name AS display_name, CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status, CASE WHEN c_custkey % 29 <> 0 THEN c_mktsegment END AS department, n_name AS location, r_name AS region, CASE WHEN c_custkey % 11 <> 0 THEN 'M' || c_nationkey END AS manager_key, CASE WHEN c_custkey % 13 <> 0 THEN 'Manager ' || c_nationkey END AS manager_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "denials": "SELECT feature_id, CAST(l_shipdate AS DATE) AS date, l_linenumber + 8 AS hour, o_custkey AS employee_id, l_quantity AS conc FROM line JOIN orders ON l_orderkey = o_orderkey, win WHERE CAST(l_shipdate AS DATE) BETWEEN d0 AND d1 AND l_returnflag = 'R' AND l_quantity >= 30",
    "short_denials": "SELECT feature_id, date, coalesce(hour, 0) AS hour, employee_id, CAST(concurrent AS DOUBLE) AS conc FROM usage WHERE denied",
    "peaks": "SELECT feature_id, date, peak, row_number() OVER (PARTITION BY feature_id ORDER BY date) - 1 AS ix FROM daily, win WHERE date BETWEEN d0 AND d1",
    "m0": f"SELECT feature_id, count(*) AS observed_days, avg(peak) AS mean, {q(0.5)} AS median, {q(0.9)} AS p90, {q(0.95)} AS p95, {q(0.99)} AS p99, max(peak) AS mx, min(peak) AS mn, stddev_samp(peak) AS sd, regr_slope(peak, ix) AS slope FROM peaks GROUP BY ALL",
    "m1": "SELECT feature_id, count(*) AS saturation_days FROM peaks JOIN feat USING (feature_id) WHERE entitled > 0 AND peak >= entitled GROUP BY ALL",
    "metrics": f"SELECT feature_id, entitled, coalesce(observed_days, 0) AS observed_days, 365 - coalesce(observed_days, 0) AS missing_days, {r('coalesce(mean, 0)', 4)} AS mean_peak, coalesce(median, 0.0) AS median, coalesce(p90, 0.0) AS p90, coalesce(p95, 0.0) AS p95, coalesce(p99, 0.0) AS p99, coalesce(mx, 0.0) AS max_peak, coalesce(mn, 0.0) AS min_peak, {r('coalesce(sd, 0)', 4)} AS std_dev, {r('coalesce(sd / nullif(mean, 0), 0)', 4)} AS volatility, {r('coalesce(slope * 365 * 100 / nullif(mean, 0), 0)', 2)} AS trend_pct, CASE WHEN entitled > 0 THEN {r('coalesce(p95, 0) / entitled * 100', 1)} ELSE 0.0 END AS utilization_pct, coalesce(saturation_days, 0) AS saturation_days, {r('coalesce(saturation_days * 1.0 / nullif(observed_days, 0), 0) * 100', 1)} AS saturation_pct, entitled - coalesce(p95, 0.0) AS available_capacity FROM feat LEFT JOIN m0 USING (feature_id) LEFT JOIN m1 USING (feature_id)",
    "capacity": "SELECT feature_id, CASE WHEN entitled <= 0 THEN 'Low' WHEN saturation_pct >= 10 OR utilization_pct >= 100 THEN 'Critical' WHEN utilization_pct >= 92 THEN 'High' WHEN utilization_pct >= 80 OR max_peak >= entitled THEN 'Moderate' ELSE 'Low' END AS risk FROM metrics",
    "idle": "SELECT act.*, CASE WHEN last_used IS NOT NULL THEN greatest(d1 - last_used, 0) END AS idle, assigned AND (last_used IS NULL OR greatest(d1 - last_used, 0) >= 90) AS cand FROM act, win",
    "seat0": "SELECT feature_id, count(*) AS observed_users, count(*) FILTER (WHERE last_used IS NULL) AS never_used, count(*) FILTER (WHERE idle <= 30) AS active30, count(*) FILTER (WHERE idle <= 60) AS active60, count(*) FILTER (WHERE idle <= 90) AS active90, count(*) FILTER (WHERE idle <= 180) AS active180, count(*) FILTER (WHERE cand) AS reclaim_candidates FROM idle WHERE assigned GROUP BY ALL",
    "seat1": "SELECT seat0.*, unit_price, license_model, CASE WHEN entitled > 0 THEN entitled ELSE observed_users END AS assigned, observed_users - reclaim_candidates AS active_users FROM seat0 JOIN feat USING (feature_id)",
    "seats": f"SELECT feature_id, license_model, assigned, active_users, never_used, active30, active60, active90, active180, reclaim_candidates, {r('reclaim_candidates * unit_price', 2)} AS reclaim_value, CASE WHEN assigned > 0 THEN {r('active_users * 100.0 / assigned', 1)} ELSE 0.0 END AS utilization_pct, observed_users, greatest(assigned - observed_users, 0) AS seats_without_user FROM seat1",
    "den0": "SELECT feature_id, count(*) AS total_denials, count(DISTINCT date) AS denial_days, count(DISTINCT employee_id) AS distinct_users, min(date) AS first_denial, max(date) AS last_denial, sum(conc) AS s FROM denials GROUP BY ALL",
    "den1": "SELECT feature_id, max(n) AS worst FROM (SELECT feature_id, date, count(*) AS n FROM denials GROUP BY ALL) GROUP BY ALL",
    "den2": "SELECT feature_id, hour AS peak_hour FROM (SELECT feature_id, hour, row_number() OVER (PARTITION BY feature_id ORDER BY count(*) DESC, hour) AS k FROM denials GROUP BY feature_id, hour) WHERE k = 1",
    "tok0": f"SELECT feature_id, count(*) AS observed_days, sum(token_hours) AS used, avg(token_hours) AS mean, {q(0.95, 'token_hours')} AS p95, regr_slope(token_hours, ix) AS slope FROM (SELECT feature_id, date, peak AS token_hours, ix FROM peaks) GROUP BY ALL",
    "tok": f"SELECT feature_id, used_pct, CASE WHEN used_pct IS NULL THEN 'Low' WHEN used_pct >= 95 THEN 'Critical' WHEN used_pct >= 85 THEN 'High' WHEN used_pct >= 70 OR (used_pct >= 60 AND trend > 15) THEN 'Moderate' ELSE 'Low' END AS token_risk FROM (SELECT feature_id, CASE WHEN entitled > 0 THEN {r('used / (entitled * 24.0 * tok0.observed_days) * 100', 1)} END AS used_pct, {r('coalesce(slope * 36500 / nullif(mean, 0), 0)', 2)} AS trend FROM tok0 JOIN feat USING (feature_id) WHERE license_model = 'token')",
    "pf0": "SELECT feat.*, m.p95, m.max_peak, m.trend_pct, m.utilization_pct, m.saturation_days, c.risk AS capacity, s.assigned, s.active_users, s.reclaim_candidates, s.reclaim_value, s.seats_without_user, t.used_pct AS token_used_pct, t.token_risk, coalesce(m.observed_days > 0, FALSE) OR s.assigned IS NOT NULL OR t.token_risk IS NOT NULL AS seen, CAST(CASE WHEN feat.license_model = 'concurrent' THEN coalesce(m.observed_days, 0) WHEN feat.license_model = 'token' OR s.assigned IS NOT NULL THEN 365 ELSE 0 END AS BIGINT) AS observed_days FROM feat LEFT JOIN (SELECT metrics.* FROM metrics JOIN feat USING (feature_id) WHERE license_model = 'concurrent') m USING (feature_id) LEFT JOIN (SELECT capacity.* FROM capacity JOIN metrics USING (feature_id) JOIN feat USING (feature_id) WHERE license_model = 'concurrent' AND observed_days > 0) c USING (feature_id) LEFT JOIN (SELECT * FROM seats WHERE license_model IN ('named_user', 'subscription')) s USING (feature_id) LEFT JOIN tok t USING (feature_id)",
    "den": f"SELECT feature_id, entitled, observed_days, total_denials, denial_days, distinct_users, worst * 1.0 / total_denials AS conc, peak_hour, first_denial, last_denial, {r('s / total_denials', 1)} AS mean_conc FROM den0 JOIN den1 USING (feature_id) JOIN den2 USING (feature_id) JOIN (SELECT feature_id, entitled, observed_days FROM pf0) USING (feature_id)",
    "denrisk": "SELECT feature_id, total_denials, CASE WHEN entitled > 0 AND mean_conc < entitled * 0.95 THEN 'Low' WHEN conc >= 0.7 AND distinct_users <= 2 THEN 'Low' WHEN rate >= 0.15 AND distinct_users >= 5 THEN 'Critical' WHEN rate >= 0.07 OR (distinct_users >= 8 AND denial_days >= 5) THEN 'High' WHEN denial_days >= 2 THEN 'Moderate' ELSE 'Low' END AS denial_risk FROM (SELECT *, coalesce(denial_days * 1.0 / nullif(observed_days, 0), 0) AS rate FROM den)",
    "pf1": f"SELECT pf0.*, total_denials, denial_risk, CASE WHEN assigned IS NOT NULL THEN {up('active_users * 1.1 + seats_without_user')} WHEN seen AND license_model = 'concurrent' THEN {up('p95 * 1.1')} END AS rec FROM pf0 LEFT JOIN denrisk USING (feature_id)",
    "pf2": "SELECT *, rec IS NOT NULL AS sized, coalesce(rec, entitled) AS recommended, coalesce(served_quantity, CASE WHEN entitled > 0 THEN entitled END) AS served, greatest(coalesce(list_position(['Low', 'Moderate', 'High', 'Critical'], capacity), 1), coalesce(list_position(['Low', 'Moderate', 'High', 'Critical'], denial_risk), 1), coalesce(list_position(['Low', 'Moderate', 'High', 'Critical'], token_risk), 1)) AS rk FROM pf1",
    "pf3": f"SELECT *, CASE WHEN seen THEN 'observed' ELSE 'not_supplied' END AS usage_evidence, {r('entitled * unit_price', 2)} AS current_cost, {r('recommended * unit_price', 2)} AS recommended_cost, CASE WHEN unit_price IS NULL THEN NULL WHEN recommended < entitled THEN {r('(entitled - recommended) * unit_price', 2)} ELSE 0.0 END AS opportunity, CASE WHEN unit_price IS NULL THEN NULL WHEN recommended > entitled THEN {r('(recommended - entitled) * unit_price', 2)} ELSE 0.0 END AS incremental, {r('purchased_quantity * unit_price', 2)} AS purchased_commitment, {r('served * unit_price', 2)} AS served_value, served - purchased_quantity AS quantity_difference, ['Low', 'Moderate', 'High', 'Critical'][rk] AS risk, CAST(renewal_date - d1 AS INTEGER) AS days_to_renewal, CAST(100 - CASE WHEN observed_days >= 300 THEN 0 WHEN observed_days >= 150 THEN 10 WHEN observed_days >= 60 THEN 22 ELSE 38 END - CASE WHEN observed_days / 365.0 >= 0.95 THEN 0 WHEN observed_days / 365.0 >= 0.8 THEN 8 ELSE 20 END - CASE WHEN unit_price IS NULL THEN 18 ELSE 0 END AS BIGINT) AS confidence_score FROM pf2, win",
    "pf": f"SELECT *, CASE WHEN unit_price IS NOT NULL THEN {r('opportunity / nullif(current_cost, 0) * 100', 1)} END AS savings_pct, CASE WHEN confidence_score >= 80 THEN 'High' WHEN confidence_score >= 55 THEN 'Medium' ELSE 'Low' END AS confidence FROM pf3",
    "ren": f"SELECT contract_id, vendor_id, vendor_name, renewal_date, days_to_renewal, count(*) AS items, {r('sum(current_cost)', 2)} AS current_spend, {r('sum(recommended_cost)', 2)} AS recommended_spend, {r('sum(opportunity)', 2)} AS opportunity, {r('sum(incremental)', 2)} AS incremental, count(*) FILTER (WHERE risk IN ('High', 'Critical')) AS capacity_exposure, {r('sum(CASE WHEN observed_days >= 30 THEN trend_pct * coalesce(current_cost, 1) END) / nullif(sum(CASE WHEN observed_days >= 30 AND trend_pct IS NOT NULL THEN coalesce(current_cost, 1) END), 0)', 1)} AS trend_pct, CAST({r('avg(confidence_score)')} AS BIGINT) AS confidence_score FROM pf WHERE contract_id IS NOT NULL GROUP BY ALL",
    "rec": f"SELECT feature_id, served_quantity, purchased_quantity, CASE WHEN served_quantity IS NULL AND purchased_quantity IS NULL THEN 'agree' WHEN served_quantity IS NULL THEN 'contract_only' WHEN purchased_quantity IS NULL THEN 'entitlement_only' WHEN served_quantity = purchased_quantity THEN 'agree' WHEN purchased_quantity > served_quantity THEN 'contract_exceeds_entitlement' ELSE 'entitlement_exceeds_contract' END AS state, served_quantity - purchased_quantity AS difference, {r('abs(served_quantity - purchased_quantity) * unit_price', 2)} AS difference_value FROM feat",
    "recsum": f"SELECT count(*) AS features, count(*) FILTER (WHERE state = 'agree') AS agreeing, count(*) FILTER (WHERE state LIKE '%exceeds%') AS disagreeing, count(*) FILTER (WHERE state = 'contract_only') AS contract_only, count(*) FILTER (WHERE state = 'entitlement_only') AS entitlement_only, {r(chr(99) + 'oalesce(sum(difference_value) FILTER (WHERE state LIKE ' + chr(39) + '%exceeds%' + chr(39) + '), 0)', 2)} AS value_at_stake, count(*) FILTER (WHERE state LIKE '%exceeds%' AND difference_value IS NULL) AS unpriced, count(*) FILTER (WHERE state = 'entitlement_exceeds_contract') AS over_deployed FROM rec",
    "iss": "SELECT * FROM (SELECT 'unmatched_users' AS issue, CASE WHEN count(DISTINCT o_custkey) > 25 THEN 'critical' ELSE 'warning' END AS severity, count(DISTINCT o_custkey) AS affected FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'unmapped_features', CASE WHEN count(*) > 10 THEN 'critical' ELSE 'warning' END, count(*) FROM pf WHERE seen AND contract_id IS NULL UNION ALL SELECT 'unpriced', 'warning', count(*) FILTER (WHERE unit_price IS NULL) FROM pf UNION ALL SELECT 'short_history', 'warning', count(*) FILTER (WHERE observed_days > 0 AND observed_days < 90) FROM pf UNION ALL SELECT 'missing_days', 'info', count(*) FILTER (WHERE observed_days > 0 AND 365 - observed_days > 20) FROM pf) WHERE affected > 0",
    "sig0": f"SELECT 1 AS seq, 'renewal:' || contract_id AS id, 'renewal' AS kind, CASE WHEN coalesce(opportunity, 0) <> coalesce(incremental, 0) THEN abs(coalesce(opportunity, 0) - coalesce(incremental, 0)) ELSE current_spend END AS impact, days_to_renewal AS urgency_days, CASE WHEN capacity_exposure > 0 THEN 'High' WHEN days_to_renewal <= 60 THEN 'Moderate' ELSE 'Low' END AS risk, CASE WHEN confidence_score >= 80 THEN 'High' WHEN confidence_score >= 55 THEN 'Medium' ELSE 'Low' END AS confidence FROM ren WHERE days_to_renewal BETWEEN 0 AND 240 UNION ALL SELECT 2, 'capacity:' || feature_id, 'capacity', incremental, days_to_renewal, risk, confidence FROM pf WHERE license_model = 'concurrent' AND seen AND risk IN ('High', 'Critical') UNION ALL SELECT 3, 'cost:' || feature_id, 'cost', opportunity, days_to_renewal, 'Low', confidence FROM pf WHERE opportunity >= 2500 UNION ALL SELECT 4, 'reclaim:' || feature_id, 'reclaim', reclaim_value, days_to_renewal, 'Low', confidence FROM pf WHERE reclaim_candidates >= 5 UNION ALL SELECT 5, 'usage:' || feature_id, 'usage', CASE WHEN trend_pct > 0 THEN incremental ELSE opportunity END, days_to_renewal, CASE WHEN trend_pct > 0 AND utilization_pct > 70 THEN 'Moderate' ELSE 'Low' END, confidence FROM pf WHERE license_model = 'concurrent' AND seen AND observed_days >= 30 AND abs(trend_pct) >= 25 UNION ALL SELECT 6, 'forecast:' || feature_id, 'forecast', {r('(floor(g + 0.5) - entitled) * unit_price', 2)}, days_to_renewal, 'Moderate', confidence FROM (SELECT *, p95 * (1 + greatest(CASE WHEN observed_days >= 30 THEN trend_pct ELSE 0 END, 0) / 100) AS g FROM pf WHERE license_model = 'concurrent' AND seen) WHERE entitled > 0 AND g > entitled AND utilization_pct < 100 UNION ALL SELECT 7, 'data:' || issue, 'data', NULL, NULL, 'Moderate', 'High' FROM iss WHERE severity <> 'info' UNION ALL SELECT 8, 'evidence:no-usage', 'data', {r('c', 2)}, soon, CASE WHEN soon <= 90 THEN 'High' ELSE 'Moderate' END, 'High' FROM (SELECT sum(current_cost) AS c, min(days_to_renewal) FILTER (WHERE days_to_renewal >= 0) AS soon, count(*) AS n FROM pf WHERE NOT seen AND current_cost > 0) WHERE n > 0 UNION ALL SELECT 9, 'reconciliation:sources', 'reconciliation', CASE WHEN value_at_stake > 0 THEN value_at_stake END, NULL, CASE WHEN over_deployed > 0 THEN 'High' ELSE 'Moderate' END, 'Medium' FROM recsum WHERE disagreeing > 0 UNION ALL SELECT 10, 'reconciliation:unmatched', 'reconciliation', CASE WHEN v > 0 THEN {r('v', 2)} END, NULL, 'Moderate', 'High' FROM (SELECT count(*) AS n, coalesce(sum(current_cost), 0) AS v FROM pf WHERE contract_id IS NULL) WHERE n > 0",
    "sig": f"SELECT id, kind, CAST(impact AS DOUBLE) AS impact, CAST(urgency_days AS INTEGER) AS urgency_days, risk, confidence, {r('(least(1, log10(abs(coalesce(impact, 0)) + 1) / log10(500001.0)) * 0.45 + CASE WHEN urgency_days IS NULL THEN 0.25 ELSE 1 - least(greatest(urgency_days, 0), 180) / 180.0 END * 0.28 + CASE risk WHEN ' + chr(39) + 'Critical' + chr(39) + ' THEN 1.0 WHEN ' + chr(39) + 'High' + chr(39) + ' THEN 0.75 WHEN ' + chr(39) + 'Moderate' + chr(39) + ' THEN 0.4 ELSE 0.1 END * 0.22 + 0.05) * CASE confidence WHEN ' + chr(39) + 'High' + chr(39) + ' THEN 1.0 WHEN ' + chr(39) + 'Medium' + chr(39) + ' THEN 0.75 ELSE 0.5 END * 100', 1)} AS score FROM sig0",
    "costs": f"SELECT feature_id, {r('entitled * unit_price', 2)} AS current_cost FROM feat",
    "cost2": f"SELECT feature_id, current_cost, {r('current_cost / 4', 2)} AS waste FROM costs",
    "sized": f"SELECT feature_id, feat.entitled, unit_price, {up('p95 * 1.1')} AS recommended FROM m0 JOIN feat USING (feature_id)",
    "fc": f"SELECT feature_id, entitled, unit_price, p95, observed_days, trend_pct, (1 + g) * 1.05 - 1 AS growth, g FROM (SELECT metrics.*, unit_price, CASE WHEN observed_days >= 30 THEN least(50, greatest(-30, trend_pct)) / 100 ELSE 0.0 END AS g FROM metrics JOIN (SELECT feature_id, unit_price FROM feat) USING (feature_id))",
}


def sql(select: str) -> str:
    """``select`` with the named subqueries that it needs, directly or through others."""
    import re

    needed: set[str] = set()
    todo = [select]
    while todo:
        text = todo.pop()
        for name in CTE:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(CTE[name])
    parts = ", ".join(f"{n} AS ({CTE[n]})" for n in CTE if n in needed)
    return f"WITH {parts} {select}" if parts else select


def _sized(basis: str, source: str) -> str:
    return f"SELECT feature_id, entitled, {r('b', 2)} AS basis, {r('b * 1.1', 4)} AS raw_recommended, rec AS recommended, rec - entitled AS quantity_delta, greatest(entitled - rec, 0) AS surplus, greatest(rec - entitled, 0) AS shortfall FROM (SELECT *, {up('b * 1.1')} AS rec FROM (SELECT feature_id, entitled, {basis} AS b FROM {source} GROUP BY ALL))"


def _money(rows: str) -> str:
    return f"SELECT feature_id, entitled, recommended, unit_price, {r('entitled * unit_price', 2)} AS current_cost, {r('recommended * unit_price', 2)} AS recommended_cost, CASE WHEN unit_price IS NULL THEN NULL WHEN recommended < entitled THEN {r('(entitled - recommended) * unit_price', 2)} ELSE 0.0 END AS opportunity, CASE WHEN unit_price IS NULL THEN NULL WHEN recommended > entitled THEN {r('(recommended - entitled) * unit_price', 2)} ELSE 0.0 END AS incremental, CASE WHEN unit_price IS NOT NULL THEN {r('CASE WHEN recommended < entitled THEN floor((entitled - recommended) * unit_price * 100 + 0.5) / 100 ELSE 0.0 END / nullif(floor(entitled * unit_price * 100 + 0.5) / 100, 0) * 100', 1)} END AS savings_pct FROM {rows}"


_WEIGHT = {
    "usage_duration": "total_hours",
    "assigned_users": "CASE WHEN assigned THEN 1.0 ELSE 0.0 END",
    "proportional_activity": "CAST(total_sessions AS DOUBLE)",
    "token_consumption": "total_hours",
    "distinct_observed_users": "CASE WHEN total_sessions > 0 OR total_hours > 0 OR last_used IS NOT NULL THEN 1.0 ELSE 0.0 END",
}


def _allocation(method: str, dim: str, extra: str = "") -> str:
    return sql(
        f"SELECT grp, {r('spend', 2)} AS allocated_spend, {r('coalesce(spend * 100 / nullif(sum(spend) OVER (), 0), 0)', 1)} AS share_pct, {r('hours', 1)} AS usage_hours, CAST(sessions AS BIGINT) AS sessions, CAST(al AS BIGINT) AS assigned_licenses, CAST(au AS BIGINT) AS active_users, CAST(ou AS BIGINT) AS observed_users, coalesce(headcount, 0) AS headcount, {r('waste', 2)} AS potential_waste, {r('spend / nullif(coalesce(headcount, 0), 0)', 2)} AS cost_per_engineer{extra} FROM ("
        f"SELECT grp, coalesce(sum(current_cost * w / full_w), 0) AS spend, coalesce(sum(CASE WHEN current_cost IS NOT NULL THEN waste * w / full_w END), 0) AS waste, sum(hours) AS hours, sum(sessions) AS sessions, sum(al) AS al, sum(au) AS au, sum(ou) AS ou FROM ("
        f"SELECT *, nullif(sum(w) OVER (PARTITION BY feature_id), 0) AS full_w FROM (SELECT feature_id, nullif(trim({dim}), '') AS grp, sum(CASE WHEN {_WEIGHT[method]} > 0 THEN {_WEIGHT[method]} END) AS w, sum(total_hours) AS hours, sum(total_sessions) AS sessions, count(*) FILTER (WHERE assigned) AS al, count(*) FILTER (WHERE total_sessions > 0) AS au, count(*) FILTER (WHERE total_sessions > 0 OR total_hours > 0 OR last_used IS NOT NULL) AS ou FROM act LEFT JOIN people USING (employee_id) GROUP BY ALL)) JOIN cost2 USING (feature_id) WHERE grp IS NOT NULL GROUP BY grp"
        f") LEFT JOIN (SELECT nullif(trim({dim}), '') AS grp, count(*) AS headcount FROM people WHERE status = 'active' GROUP BY ALL) USING (grp)"
    )


_PF = "feature_id, feature_name, product_id, vendor_id, vendor_name, license_model, entitled, served_quantity, purchased_quantity, unit_price, contract_id, renewal_date, observed_days, p95, max_peak, trend_pct, utilization_pct, saturation_days, capacity, assigned, active_users, reclaim_candidates, reclaim_value, seats_without_user, token_used_pct, token_risk, usage_evidence, total_denials, denial_risk, sized, recommended, current_cost, recommended_cost, opportunity, incremental, savings_pct, purchased_commitment, served_value, quantity_difference, risk, days_to_renewal, confidence_score, confidence"
_TOTALS = f"SELECT {r('sp', 2)} AS annual_spend, {r('bo', 2)} AS purchased_commitment, bn AS purchased_priced, {r('bo - sp', 2)} AS commitment_gap, {r('re', 2)} AS recommended_spend, {r('op', 2)} AS opportunity, {r('ic', 2)} AS incremental, {r('re - sp', 2)} AS net_change, pn AS priced_features, n - pn AS unpriced_features, vn AS vendor_count, {r('coalesce(top / nullif(sp, 0), 0)', 4)} AS vendor_concentration FROM (SELECT coalesce(sum(current_cost), 0) AS sp, coalesce(sum(recommended_cost), 0) AS re, coalesce(sum(opportunity), 0) AS op, coalesce(sum(incremental), 0) AS ic, coalesce(sum(purchased_commitment), 0) AS bo, count(purchased_commitment) AS bn, count(unit_price) AS pn, count(*) AS n, count(DISTINCT vendor_id) FILTER (WHERE current_cost IS NOT NULL) AS vn FROM pf), (SELECT max(s) AS top FROM (SELECT sum(current_cost) AS s FROM pf GROUP BY vendor_id))"
_RENEWALS = "SELECT contract_id, vendor_id, vendor_name, renewal_date, days_to_renewal, CASE WHEN days_to_renewal <= 0 THEN 'renewed' WHEN days_to_renewal <= 30 THEN 'finalize' WHEN days_to_renewal <= 60 THEN 'negotiate' WHEN days_to_renewal <= 90 THEN 'recommend' WHEN days_to_renewal <= 120 THEN 'validate' ELSE 'analyze' END AS stage, CASE WHEN days_to_renewal IS NULL THEN 'unknown' WHEN days_to_renewal < 0 THEN 'lapsed' WHEN days_to_renewal <= 30 THEN 'critical' WHEN days_to_renewal <= 60 THEN 'high' WHEN days_to_renewal <= 90 THEN 'medium' ELSE 'low' END AS urgency, items, current_spend, recommended_spend, opportunity, incremental, capacity_exposure, trend_pct, confidence_score, CASE WHEN confidence_score >= 80 THEN 'High' WHEN confidence_score >= 55 THEN 'Medium' ELSE 'Low' END AS confidence FROM ren"
_LABELS = "CASE WHEN observed_days >= 300 THEN 'Observation period' END, CASE WHEN observed_days / 365.0 >= 0.95 THEN 'Data completeness' END, CASE WHEN unit_price IS NOT NULL THEN 'Pricing' END, 'Feature mapping', 'Denials'"
_FAULTS = "CASE WHEN observed_days < 300 THEN 'Observation period' END, CASE WHEN observed_days / 365.0 < 0.95 THEN 'Data completeness' END, CASE WHEN unit_price IS NULL THEN 'Pricing' END, 'Employee mapping', 'Forecast inputs'"


def oracle_sql() -> dict[str, str]:
    from seatmetrics import evidence_oracles, ingest_oracles, page_oracles

    out = {
        "hourly_concurrency": "SELECT * FROM hourly",
        "daily_rollup": f"SELECT u.feature_id, u.date, coalesce(h.peak, 0.0) AS peak, {r('coalesce(h.mean, 0)', 3)} AS mean_concurrent, {r('coalesce(u.hours, 0)', 2)} AS usage_hours, unique_users, without_concurrency, h.peak IS NULL AS daily_only FROM (SELECT feature_id, date, sum(duration_hours) AS hours, count(DISTINCT lower(trim(usr))) AS unique_users, count(*) FILTER (WHERE concurrent IS NULL) AS without_concurrency FROM usage GROUP BY ALL) u LEFT JOIN (SELECT feature_id, date, max(concurrent) AS peak, avg(concurrent) AS mean FROM hourly GROUP BY ALL) h USING (feature_id, date)",
        "hourly_to_daily": f"SELECT feature_id, date, max(concurrent) AS peak, {r('avg(concurrent)', 3)} AS mean_concurrent, sum(concurrent) AS usage_hours FROM hourly GROUP BY ALL",
        "concurrent_metrics": "SELECT * FROM metrics",
        "capacity_risk": "SELECT feature_id, risk, CASE WHEN observed_days >= 30 THEN trend_pct END AS trend_pct FROM capacity JOIN metrics USING (feature_id)",
        "daily_series": "SELECT date, peak FROM daily, win WHERE feature_id = 'Brand#1' AND date BETWEEN d0 AND d1",
        "monthly_peaks": f"SELECT feature_id, strftime(date, '%Y-%m') AS month, {r('avg(peak)', 1)} AS mean_peak, max(peak) AS max_peak FROM daily GROUP BY ALL",
        "hourly_profile": f"SELECT feature_id, CAST(h AS INTEGER) AS hour, {r('coalesce(m, 0)', 1)} AS mean_concurrent FROM (SELECT DISTINCT feature_id FROM hourly), range(24) t(h) LEFT JOIN (SELECT feature_id AS f, hour AS hh, avg(concurrent) AS m FROM hourly GROUP BY ALL) ON f = feature_id AND hh = h",
        "weekday_hour_grid": f"SELECT feature_id, CAST(dayofweek(date) AS INTEGER) AS weekday, hour, {r('avg(concurrent)', 1)} AS mean_concurrent FROM hourly GROUP BY feature_id, weekday, hour",
        "user_activity": f"SELECT feature_id, lower(trim(usr)) AS \"user\", max(date) AS last_used, count(*) AS total_sessions, {r('coalesce(sum(duration_hours), 0)', 2)} AS total_hours FROM usage GROUP BY ALL",
        "denial_events": "SELECT feature_id, date, hour, employee_id, CAST(1 AS BIGINT) AS count, conc AS concurrent_at_denial FROM short_denials",
        "largest_entitlement": "SELECT feature_id, quantity, source_row FROM (SELECT p_brand AS feature_id, p_size AS quantity, p_partkey AS source_row, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part) WHERE k = 1",
        "coverage": "SELECT count(*) AS rows, count(DISTINCT feature_id) AS features, count(DISTINCT lower(trim(usr))) AS users, min(date) AS first_date, max(date) AS last_date, bool_or(concurrent IS NOT NULL) AS has_concurrency, bool_or(denied) AS has_denials, bool_or(duration_hours IS NOT NULL) AS has_durations, CAST(max(date) - min(date) + 1 AS BIGINT) AS history_days FROM usage",
        "right_sizing": _sized(q(0.95), "(SELECT feature_id, entitled, peak FROM short_daily JOIN short_ent USING (feature_id), short_win WHERE date BETWEEN d0 AND d1)"),
        "right_sizing_max": _sized("max(peak)", "(SELECT feature_id, entitled, peak FROM short_daily JOIN short_ent USING (feature_id), short_win WHERE date BETWEEN d0 AND d1)"),
        "sensitivity": f"SELECT feature_id, v AS variant, rec AS recommended, rec - base AS difference, rec - entitled AS quantity_delta FROM (SELECT feature_id, entitled, {up('p95 * 1.1')} AS base, unnest(['base', 'p90', 'p99', 'growth_10', 'no_safety']) AS v, unnest([{up('p95 * 1.1')}, {up('p90 * 1.1')}, {up('p99 * 1.1')}, {up('p95 * 1.1 * 1.1')}, {up('p95 * 1.0')}]) AS rec FROM m0 JOIN feat USING (feature_id))",
        "financials": _money("sized"),
        "forecast": f"SELECT *, {r('(recommended - entitled) * unit_price', 2)} AS financial_impact FROM (SELECT *, {up('forecast_demand * 1.1')} AS recommended FROM (SELECT feature_id, entitled, unit_price, p95 AS current_p95, {r('g', 4)} AS trend_growth, CAST(0.05 AS DOUBLE) AS headcount_growth, {r('growth', 4)} AS combined_growth, {r('p95 * (1 + growth)', 2)} AS forecast_demand, CASE WHEN observed_days < 30 THEN 'no trend: too little history' WHEN trend_pct > 50 THEN 'capped' WHEN trend_pct < -30 THEN 'floored' END AS trend_note FROM fc))",
        "forecast_curve": f"SELECT feature_id, CAST(m AS INTEGER) AS month_offset, {r('p95 * (1 + growth * (m / 12.0))', 1)} AS demand FROM fc, range(13) t(m)",
        "forecast_spend": f"SELECT {r('coalesce(sum(rec * unit_price * 1.03), 0)', 2)} AS forecast_spend, count(unit_price) AS priced_features FROM (SELECT unit_price, {up(r('p95 * (1 + growth)', 2) + ' * 1.1')} AS rec FROM fc)",
        "scenario_rollup": f"SELECT count(*) AS features, CAST(sum(recommended) AS BIGINT) AS recommended, {r('sum(opportunity)', 2)} AS opportunity, {r('sum(incremental)', 2)} AS incremental FROM ({_money(chr(40) + 'SELECT feature_id, feat.entitled, unit_price, ' + up('p99 * 1.05 * 1.2') + ' AS recommended FROM m0 JOIN feat USING (feature_id)' + chr(41))})",
        "named_user_metrics": "SELECT * EXCLUDE (license_model) FROM seats",
        "named_user_sizing": f"SELECT feature_id, assigned AS entitled, CAST(active_users AS DOUBLE) AS basis, {r('active_users * 1.1 + seats_without_user', 4)} AS raw_recommended, rec AS recommended, rec - assigned AS quantity_delta, greatest(assigned - rec, 0) AS surplus, greatest(rec - assigned, 0) AS shortfall FROM (SELECT *, {up('active_users * 1.1 + seats_without_user')} AS rec FROM seats)",
        "reclaim_queue": "SELECT feature_id, employee_id, display_name, department, last_used, CAST(idle AS INTEGER) AS idle_days, unit_price AS annual_value FROM idle JOIN feat USING (feature_id) LEFT JOIN people USING (employee_id) WHERE cand AND license_model IN ('named_user', 'subscription')",
        "reclaim_value": f"SELECT {r('coalesce(sum(unit_price), 0)', 2)} AS reclaim_value, count(*) AS seats, count(unit_price) AS priced_seats FROM idle JOIN feat USING (feature_id) WHERE cand AND license_model IN ('named_user', 'subscription')",
        "inactivity_histogram": "SELECT CAST(place AS INTEGER) AS place, bucket, count(idle.feature_id) AS seats FROM (SELECT unnest(range(6)) AS place, unnest(['0–30 days', '31–60 days', '61–90 days', '91–180 days', '180+ days', 'Never used']) AS bucket) LEFT JOIN idle ON assigned AND place = CASE WHEN idle.idle IS NULL THEN 5 WHEN idle.idle <= 30 THEN 0 WHEN idle.idle <= 60 THEN 1 WHEN idle.idle <= 90 THEN 2 WHEN idle.idle <= 180 THEN 3 ELSE 4 END GROUP BY ALL",
        "token_metrics": f"SELECT *, CASE WHEN used_pct IS NULL THEN 'Low' WHEN used_pct >= 95 THEN 'Critical' WHEN used_pct >= 85 THEN 'High' WHEN used_pct >= 70 OR (used_pct >= 60 AND trend_pct > 15) THEN 'Moderate' ELSE 'Low' END AS risk, {r('p95_token_hours * (1 + least(100, greatest(-50, trend_pct)) / 100)', 2)} AS forecast_token_hours FROM (SELECT feature_id, observed_days, {r('mean', 2)} AS mean_token_hours, {r('mx', 2)} AS peak_token_hours, {r('p95', 2)} AS p95_token_hours, CASE WHEN entitled > 0 THEN {r('entitled * 24 * observed_days', 2)} END AS available_token_hours, CASE WHEN entitled > 0 THEN {r('used / (entitled * 24.0 * observed_days) * 100', 1)} END AS used_pct, {r('coalesce(slope * 36500 / nullif(mean, 0), 0)', 2)} AS trend_pct, CAST(pk AS DOUBLE) AS peak_tokens FROM (SELECT feature_id, count(*) AS observed_days, avg(token_hours) AS mean, max(token_hours) AS mx, sum(token_hours) AS used, {q(0.95, 'token_hours')} AS p95, regr_slope(token_hours, ix) AS slope, max(peak_tokens) AS pk FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY date) - 1 AS ix FROM short_tokens, short_win WHERE date BETWEEN d0 AND d1) GROUP BY ALL) JOIN short_ent USING (feature_id))",
        "token_monthly": f"SELECT feature_id, strftime(date, '%Y-%m') AS month, {r('sum(token_hours)', 1)} AS token_hours FROM short_tokens, short_win WHERE date BETWEEN d0 AND d1 GROUP BY feature_id, month",
        "peak_token_draw": "SELECT feature_id, CAST(max(peak_tokens) AS BIGINT) AS peak_tokens FROM short_tokens GROUP BY ALL",
        "denial_metrics": f"SELECT feature_id, total_denials, denial_days, distinct_users, {r('conc', 3)} AS concentration, peak_hour, first_denial, last_denial, mean_conc AS mean_concurrent_at_denial, CASE WHEN entitled > 0 AND mean_conc < entitled * 0.95 THEN 'Low' WHEN conc >= 0.7 AND distinct_users <= 2 THEN 'Low' WHEN denial_days / 365.0 >= 0.15 AND distinct_users >= 5 THEN 'Critical' WHEN denial_days / 365.0 >= 0.07 OR (distinct_users >= 8 AND denial_days >= 5) THEN 'High' WHEN denial_days >= 2 THEN 'Moderate' ELSE 'Low' END AS risk FROM den",
        "denials_by_hour": "SELECT CAST(h AS INTEGER) AS hour, count(d.hour) AS denials FROM range(24) t(h) LEFT JOIN short_denials d ON d.hour = h GROUP BY ALL",
        "denials_by_group": "SELECT coalesce(department, 'Unattributed') AS grp, count(*) AS denials FROM short_denials LEFT JOIN people USING (employee_id) GROUP BY ALL",
        "portfolio_rows": f"SELECT {_PF} FROM pf",
        **{f"portfolio_p{p * 100:g}": f"SELECT feature_id, p95, sized, x AS recommended, {r('x * unit_price', 2)} AS recommended_cost, CASE WHEN unit_price IS NULL THEN NULL WHEN x < entitled THEN {r('(entitled - x) * unit_price', 2)} ELSE 0.0 END AS opportunity FROM (SELECT pf.*, CASE WHEN license_model = 'concurrent' AND seen THEN b ELSE recommended END AS x FROM pf LEFT JOIN (SELECT feature_id, {up(q(p) + ' * 1.1')} AS b FROM peaks GROUP BY ALL) USING (feature_id))" for p in (0.85, 0.97)},
        "portfolio_totals": _TOTALS,
        "unused_capacity": f"SELECT {r('coalesce(sum((entitled - p95) * unit_price), 0)', 2)} AS amount, count(*) AS features FROM pf WHERE license_model = 'concurrent' AND unit_price IS NOT NULL AND seen AND entitled > p95",
        "portfolio_filter_sort": "SELECT feature_id, vendor_name, risk, current_cost FROM pf WHERE risk IN ('High', 'Critical')",
        "cost_bridge": f"SELECT seq, step, amount, {r('sum(amount) OVER (ORDER BY seq)', 2)} AS running_total FROM (SELECT unnest([1, 2, 3]) AS seq, unnest(['current', 'savings', 'additions']) AS step, unnest([annual_spend, -opportunity, incremental]) AS amount FROM ({_TOTALS}))",
        "data_quality": "SELECT * FROM iss",
        "confidence_rows": f"SELECT feature_id, score AS confidence_score, CASE WHEN score >= 80 THEN 'High' WHEN score >= 55 THEN 'Medium' ELSE 'Low' END AS confidence, concat_ws(', ', {_LABELS}) AS strengths, concat_ws(', ', {_FAULTS}) AS weaknesses FROM (SELECT metrics.feature_id, observed_days, unit_price, CAST(100 - CASE WHEN observed_days >= 300 THEN 0 WHEN observed_days >= 150 THEN 10 WHEN observed_days >= 60 THEN 22 ELSE 38 END - CASE WHEN observed_days / 365.0 >= 0.95 THEN 0 WHEN observed_days / 365.0 >= 0.8 THEN 8 ELSE 20 END - CASE WHEN unit_price IS NULL THEN 18 ELSE 0 END - 7 - 5 AS BIGINT) AS score FROM metrics JOIN feat USING (feature_id))",
        "portfolio_confidence": f"SELECT score, high, low, features, CASE WHEN score >= 80 THEN 'High' WHEN score >= 55 THEN 'Medium' ELSE 'Low' END AS level FROM (SELECT CAST({r('avg(confidence_score)')} AS BIGINT) AS score, count(*) FILTER (WHERE confidence = 'High') AS high, count(*) FILTER (WHERE confidence = 'Low') AS low, count(*) AS features FROM pf)",
        "renewals": _RENEWALS,
        "renewal_exposure": f"SELECT b AS bucket, count(feature_id) AS lines, {r('coalesce(sum(current_cost), 0)', 2)} AS annual_cost, count(feature_id) FILTER (WHERE current_cost IS NULL) AS unpriced_lines, {r('coalesce(sum(opportunity), 0)', 2)} AS opportunity FROM (SELECT unnest(['30', '60', '90', '180', '365', 'lapsed', 'undated']) AS b) LEFT JOIN pf ON CASE WHEN days_to_renewal IS NULL THEN b = 'undated' WHEN days_to_renewal < 0 THEN b = 'lapsed' ELSE b NOT IN ('lapsed', 'undated') AND days_to_renewal <= try_cast(b AS INTEGER) END GROUP BY b",
        "renewal_priority": f"SELECT contract_id, days_to_renewal, days_to_renewal <= 90 AS soon, {r('coalesce(current_spend, 0) + coalesce(opportunity, 0)', 2)} AS value FROM ren",
        "reconciliation": "SELECT * FROM rec",
        "reconciliation_summary": "SELECT * FROM recsum",
        "vendor_spend": f"SELECT vendor_id, vendor_name, {r('coalesce(sum(current_cost), 0)', 2)} AS spend, count(*) AS features FROM pf GROUP BY ALL",
        "top_opportunities": "SELECT feature_id, opportunity, risk FROM pf WHERE opportunity > 0 ORDER BY opportunity DESC, feature_id LIMIT 5",
        "cost_per_head": f"SELECT {r('sp', 2)} AS spend, en AS engineers, us AS users, {r('sp / nullif(en, 0)', 2)} AS cost_per_engineer, {r('sp / nullif(us, 0)', 2)} AS cost_per_active_user FROM (SELECT coalesce(sum(current_cost), 0) AS sp FROM pf), (SELECT count(*) AS en FROM people WHERE status = 'active'), (SELECT count(DISTINCT employee_id) AS us FROM act WHERE total_sessions > 0 OR total_hours > 0 OR last_used IS NOT NULL)",
        "signal_rows": "SELECT * FROM sig",
        "decisions": "SELECT id, kind, CASE kind WHEN 'renewal' THEN 'negotiate' WHEN 'capacity' THEN 'increase' WHEN 'cost' THEN 'reduce' WHEN 'reclaim' THEN 'reclaim' WHEN 'usage' THEN 'review' WHEN 'forecast' THEN 'increase' WHEN 'data' THEN 'resolve' ELSE 'reconcile' END AS action, impact, score, CASE id WHEN 'renewal:contract:1' THEN 'accepted' WHEN 'cost:Brand#1' THEN 'dismissed' ELSE 'open' END AS status FROM sig",
        "executive_actions": f"SELECT * FROM (SELECT unnest(['reduce', 'increase', 'reclaim']) AS action, unnest([{r('o', 2)}, {r('i', 2)}, {r('v', 2)}]) AS amount FROM (SELECT coalesce(sum(opportunity), 0) AS o, coalesce(sum(incremental), 0) AS i, coalesce(sum(reclaim_value), 0) AS v FROM pf) UNION ALL SELECT 'renew', {r('coalesce(sum(current_spend), 0)', 2)} FROM ren WHERE days_to_renewal BETWEEN 0 AND 90) WHERE amount > 0",
        "allocation_check": f"SELECT {r('coalesce(sum(current_cost * p), 0)', 2)} AS allocated, {r('coalesce(sum(current_cost * (1 - p)), 0)', 2)} AS unallocated, {r('coalesce(sum(current_cost), 0)', 2)} AS allocatable, {r('coalesce(sum(CASE WHEN f IS NOT NULL THEN current_cost * (1 - p) END), 0)', 2)} AS unresolved_identity_cost, count(*) FILTER (WHERE f IS NULL) AS features_without_activity FROM (SELECT current_cost, f, coalesce(n / nullif(f, 0), 0) AS p FROM costs LEFT JOIN (SELECT feature_id, sum(total_hours) AS f, sum(total_hours) FILTER (WHERE nullif(trim(department), '') IS NOT NULL) AS n FROM act LEFT JOIN people USING (employee_id) WHERE total_hours > 0 GROUP BY ALL) USING (feature_id) WHERE current_cost IS NOT NULL)",
        "drill_path": "SELECT region, location, department, sum(total_hours) AS hours, count(DISTINCT employee_id) AS users, CAST(grouping(region, location, department) AS BIGINT) AS level FROM act JOIN people USING (employee_id) GROUP BY ROLLUP (region, location, department)",
        "manager_rollup": f"SELECT p.manager, manager_name, linked, reports, coalesce(ar, 0) AS active_reports, coalesce(fu, 0) AS features_used, coalesce(st, 0) AS assigned_seats, coalesce(rc, 0) AS reclaim_candidates, CASE WHEN rc > 0 THEN {r('v', 2)} END AS reclaim_value FROM (SELECT manager, count(*) AS reports, min(manager_name) AS manager_name, bool_or(manager_key IS NOT NULL) AS linked FROM (SELECT *, CASE WHEN manager_key IS NOT NULL THEN 'key:' || lower(manager_key) ELSE 'name:' || coalesce(manager_name, '') END AS manager FROM people WHERE manager_key IS NOT NULL OR manager_name IS NOT NULL) GROUP BY manager) p LEFT JOIN (SELECT manager, count(DISTINCT employee_id) FILTER (WHERE total_sessions > 0 OR total_hours > 0 OR last_used IS NOT NULL) AS ar, count(DISTINCT feature_id) AS fu, count(*) FILTER (WHERE seat) AS st, count(*) FILTER (WHERE seat AND d1 - last_used >= 90) AS rc, sum(unit_price) FILTER (WHERE seat AND d1 - last_used >= 90) AS v FROM (SELECT act.*, d1, unit_price, assigned AND license_model IN ('named_user', 'subscription') AS seat, CASE WHEN manager_key IS NOT NULL THEN 'key:' || lower(manager_key) ELSE 'name:' || coalesce(manager_name, '') END AS manager FROM act JOIN people USING (employee_id) JOIN feat USING (feature_id), win WHERE manager_key IS NOT NULL OR manager_name IS NOT NULL) GROUP BY manager) a ON a.manager = p.manager",
        "demand_drivers": f"SELECT grp, hours, {r('hours * 100 / (SELECT sum(total_hours) FROM act JOIN people USING (employee_id) WHERE location IS NOT NULL)', 1)} AS share_pct FROM (SELECT location AS grp, sum(total_hours) AS hours FROM act JOIN people USING (employee_id) WHERE location IS NOT NULL GROUP BY ALL) ORDER BY hours DESC, grp LIMIT 5",
        "users_filter": "SELECT employee_id, display_name, total_hours, CAST(idle AS INTEGER) AS idle_days FROM idle LEFT JOIN people USING (employee_id) WHERE feature_id = 'Brand#3' AND (idle IS NULL OR idle >= 90) AND contains(lower(concat_ws(' ', display_name, department)), 'build') ORDER BY total_hours DESC, employee_id LIMIT 250",
    }
    out = {k: sql(v) for k, v in out.items()}
    for method in _WEIGHT:
        out[f"allocation_{method}_department"] = _allocation(method, "department")
    for dim in ("location", "region", "manager_key", "status"):
        out[f"allocation_usage_duration_{dim}"] = _allocation("usage_duration", dim)
    out["allocation_auto"] = _allocation("usage_duration", "department", ", 'usage_duration' AS method")
    return out | ingest_oracles.oracle_sql() | page_oracles.oracle_sql() | evidence_oracles.oracle_sql()
