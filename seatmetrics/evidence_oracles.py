"""DuckDB statements for the queries of ``evidence_queries``."""

from __future__ import annotations

from seatmetrics.ingest_oracles import key

_COLUMNS = """
WITH l AS (SELECT floor(l_quantity) AS q, l_extendedprice AS t, round(l_extendedprice / l_quantity, 2) AS p, l_linenumber % 3 <> 0 AS dated FROM lineitem),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE dated) AS d, count(*) FILTER (WHERE abs(q * p - t) <= 0.005 * abs(t) + 0.005) >= 0.9 * count(*) AS proven, (SELECT count(*) FROM events) AS e FROM l)
SELECT file, header, field, confidence, CAST(cells AS BIGINT) AS cells, CAST(numbers AS BIGINT) AS numbers, CAST(dates AS BIGINT) AS dates FROM (
  SELECT unnest([f, f, f, f, f, f]) AS file, unnest(['Item', 'Unit Price', 'Price Total', 'Term Start', 'Renew By', 'Renewal Note']) AS header,
    unnest(['feature', 'unit_price', CASE WHEN proven AND f = 'purchases' THEN 'total_cost' END, 'start_date', 'renewal_date', 'notes']) AS field,
    unnest(['exact', 'exact', CASE WHEN proven AND f = 'purchases' THEN 'strong' ELSE 'ambiguous' END, 'exact', 'exact', 'possible']) AS confidence,
    unnest([n, n, n, n, n, n]) AS cells, unnest([0, n, n, 0, 0, 0]) AS numbers, unnest([0, 0, 0, n, d, 0]) AS dates FROM c, (VALUES ('purchases'), ('no quantity')) t(f)
  UNION ALL SELECT 'purchases', 'Qty', 'quantity', 'exact', n, n, 0 FROM c
  UNION ALL SELECT 'log', unnest(['Log Date', 'Network User', 'Licenses Checked Out', 'Module', 'Elapsed Remark', 'Status']), unnest(['date', 'user', 'concurrent', 'feature', NULL, 'denied']),
    unnest(['exact', 'exact', 'exact', 'exact', 'none', 'exact']), unnest([e, e, e, e, e, e]), unnest([0, 0, e, 0, 0, 0]), unnest([e, 0, 0, 0, 0, 0]) FROM c)
"""
_MIXED = """
WITH s AS (SELECT event_id AS i, event_id % 3 AS r, event_type AS t, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id AS u, ts FROM events),
d AS (SELECT *, CASE r WHEN 0 THEN 'flexnet' WHEN 1 THEN 'rlm' ELSE 'sentinel' END AS source, CASE WHEN r < 2 AND t = 'error' THEN TRUE WHEN r < 2 AND t = 'view' THEN FALSE END AS denied,
  row_number() OVER (PARTITION BY r, CAST(ts AS DATE), u, k, CASE WHEN r = 2 THEN date_trunc('second', ts) END ORDER BY i) AS place FROM s),
ok AS (SELECT * FROM d WHERE place = 1)
"""
_FIELDS = "date hour feature user employee_code product vendor quantity concurrent peak available duration_hours denied denial_count license_server pool tokens hostname version borrowed observed_at checkout_at checkin_at".split()
_DATA = """
WITH us AS (SELECT lower('F' || json_extract_string(props, '$.k')) AS f, 'user' || user_id AS u, CAST(ts AS DATE) AS d, event_type = 'view' AS c, CASE WHEN event_id % 3 = 0 THEN 'rlm' ELSE 'flexnet' END AS s FROM events),
pe AS (SELECT 'user' || c_custkey AS u FROM customer),
co AS (SELECT 'f' || (o_orderkey % 120) AS f, o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 AS priced, o_orderkey % 4 = 0 AS dated, CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' END AS cur FROM orders),
cov AS (SELECT (SELECT count(*) FROM us) AS usage_records, (SELECT count(*) FROM part) AS entitlements_records, (SELECT count(*) FROM pe) AS people_records, (SELECT count(*) FROM co) AS contracts_records,
  (SELECT count(*) FROM co WHERE priced) AS priced_contracts, (SELECT count(*) FROM co WHERE dated) AS dated_contracts, (SELECT count(*) FROM (SELECT f FROM us UNION SELECT f FROM co)) AS distinct_features,
  (SELECT count(*) FROM (SELECT u FROM us UNION SELECT u FROM pe)) AS distinct_users, (SELECT coalesce(string_agg(cur, '|' ORDER BY cur), '') FROM (SELECT DISTINCT cur FROM co WHERE cur IS NOT NULL)) AS currencies,
  (SELECT string_agg(s, '|' ORDER BY s) FROM (SELECT s FROM us UNION SELECT 'flexnet' FROM part UNION SELECT 'generic' FROM customer UNION SELECT 'generic' FROM orders)) AS sources,
  (SELECT min(d) FROM us) AS first_date, (SELECT max(d) FROM us) AS last_date, (SELECT count(*) > 0 FROM us) AS has_timed, (SELECT bool_or(c) FROM us) AS has_concurrency, FALSE AS has_denials,
  (SELECT CAST(max(d) - min(d) + 1 AS BIGINT) FROM us) AS history_days),
facts AS (SELECT (SELECT count(*) FROM pe WHERE u IN (SELECT u FROM us)) AS resolved_people, (SELECT count(DISTINCT d) FROM us) AS distinct_dates)
"""


def _needs() -> str:
    from seatmetrics.plans.trust import NEEDS

    rows = ", ".join(f"({k}, '{name}', [{', '.join(repr(n) for n in needs)}])" for k, (name, needs) in enumerate(NEEDS.items()))
    return f"needs AS (SELECT * FROM (VALUES {rows}) t(place, capability, need))"


def _labels(names: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in names.items()) + "}"


def _quality() -> str:
    named = {"flexnet": ("date", "feature", "user", "concurrent", "denied", "tokens"), "rlm": ("date", "feature", "user", "concurrent", "denied"), "sentinel": ("date", "observed_at", "feature", "user", "concurrent", "denied")}
    lacks = {"flexnet": (), "rlm": ("tokens",), "sentinel": ("tokens", "checkout_at", "checkin_at")}
    rows = ", ".join(f"('{s}', '{f}', {f in named[s]}, {f not in lacks[s]})" for s in named for f in _FIELDS)
    return (
        _MIXED
        + f", g AS (SELECT source, count(*) AS n, count(denied) AS known FROM ok GROUP BY source), c AS (SELECT t.source, field, carried, mapped, n, CASE WHEN NOT mapped THEN 0 WHEN field = 'denied' THEN known ELSE n END AS present FROM (VALUES {rows}) t(source, field, mapped, carried) JOIN g ON g.source = t.source) "
        "SELECT source, field, CAST(present AS BIGINT) AS present, floor(100.0 * present / n + 0.5) AS coverage_pct, carried, CASE WHEN NOT carried THEN 'not carried' WHEN NOT mapped THEN 'not mapped' WHEN present = 0 THEN 'empty' ELSE '' END AS reason FROM c"
    )


_DECISIONS = f"""
WITH e AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'feature' ELSE 'user' END AS kind, 'raw ' || (o_custkey % 40) AS raw, CASE WHEN o_orderkey % 2 = 0 THEN {key("'Mech Ent-' || (o_orderkey % 9)")} ELSE 'mech ent-' || (o_orderkey % 9) END AS target,
  CASE WHEN o_orderkey % 5 = 0 THEN 'rejected' ELSE 'confirmed' END AS decision, o_orderkey % 7 = 0 AS undo, CAST(o_orderdate AS TIMESTAMP) AS decided_at, o_orderkey AS seq FROM orders),
s AS (SELECT *, row_number() OVER (PARTITION BY kind, raw ORDER BY decided_at DESC, seq DESC) AS place, count(*) OVER (PARTITION BY kind, raw) AS changes FROM e)
"""


def _clauses() -> str:
    """Each clause with its condition, in order; ``{}`` stands for the number of the clause."""
    conc = "sized AND license_model = 'concurrent' AND p95 IS NOT NULL"
    money = lambda x: f"'$' || format('{{:,.2f}}', {x})"
    many = lambda x: f"format('{{:,}}', CAST(floor({x} + 0.5) AS BIGINT))"
    pct = lambda x: f"format('{{:,.1f}}', {x}) || '%'"
    day = lambda d: f"strftime({d}, '%-d %b %Y')"
    gap, trend = "365 - observed_days", "CASE WHEN observed_days >= 30 THEN trend_pct END"
    differ = "CASE WHEN recommended = entitled THEN 'as many as are needed' WHEN recommended < entitled THEN format('{:,}', entitled - recommended) || ' more than are needed' ELSE format('{:,}', recommended - entitled) || ' fewer than are needed' END"
    period = "CASE WHEN observed_days >= 300 THEN 0 WHEN observed_days >= 150 THEN 10 WHEN observed_days >= 60 THEN 22 ELSE 38 END"
    cover = "CASE WHEN observed_days / 365.0 >= 0.95 THEN 0 WHEN observed_days / 365.0 >= 0.8 THEN 8 ELSE 20 END"
    rows = {
        "derivation": [
            (conc, "P95 daily peak", many("p95"), "NULL"), (conc, "Growth factor", "'x 1.00'", "'no growth'"), (conc, "Safety factor", "'x 1.10'", "'+10.0% on top'"), ("sized", "Recommended quantity", many("recommended"), "NULL"), ("sized", "Current entitlement", many("entitled"), differ),
            ("unit_price IS NOT NULL", "Unit price", money("unit_price"), "NULL"), ("unit_price IS NOT NULL", "Current annual cost", money("current_cost"), "NULL"), ("unit_price IS NOT NULL AND sized", "Recommended annual cost", money("recommended_cost"), "NULL"),
            ("opportunity > 0", "Annual opportunity", money("opportunity"), pct("savings_pct") + " || ' of what it costs'"), ("incremental > 0", "Incremental annual spend", money("incremental"), "NULL"), ("unit_price IS NULL", "Financial impact", "'Not available'", "'there is no unit price'"),
        ],
        "assumptions": [
            (conc, "Percentile", "'P95'", "NULL"), ("sized", "Observation period", "'12m'", "NULL"), ("sized", "Growth", "'+0.0%'", "NULL"), ("sized", "Safety buffer", "'+10.0%'", "NULL"), (conc, "Method", "'P95 of daily peaks × 1.00 growth × 1.10 safety, rounded up.'", "NULL"),
        ],
        "observations": [
            ("seen", "Observed days", many("observed_days"), f"{day('win.d0')} || ' - ' || {day('win.d1')}"), (conc, "Maximum daily peak", many("max_peak"), "NULL"), (conc, "Utilization at P95", pct("utilization_pct"), "NULL"), (conc, "Saturation days", many("saturation_days"), "NULL"),
            (f"{conc} AND ({trend}) IS NOT NULL", "Demand trend", pct("trend_pct"), "'a year'"), (f"{conc} AND ({trend}) IS NULL", "Demand trend", "'Insufficient history'", "NULL"), (f"{conc} AND {gap} > 0", "Missing days", many(gap), "NULL"),
            ("assigned IS NOT NULL", "Assigned seats", many("assigned"), "NULL"), ("assigned IS NOT NULL", "Active users", many("active_users"), "NULL"), ("total_denials > 0", "Denials", many("total_denials"), "denial_risk"),
        ],
        "why": [(f"{period} > 0", "Observation period", many(period), "'points less'"), (f"{cover} > 0", "Data completeness", many(cover), "'points less'"), ("unit_price IS NULL", "Pricing", "'18'", "'points less'"), ("TRUE", "Employee mapping", "'7'", "'points less'")],
        "improve": [(f"{gap} > 0", "Usage", many(gap), "'days without usage to import'"), ("unit_price IS NULL", "Prices", "'A contract or price list'", "NULL"), ("TRUE", "People", "'10.0%'", "'of usage belongs to nobody known'")],
        "not_assumed": [(f"{gap} > 0", "Days without usage", many(gap), "'are not taken as days without demand'"), (f"{gap} <= 0", "Window", "'complete'", "'nothing was inferred for other days'"), ("unit_price IS NULL", "Price", "'none'", "'no list price stands in for it'"), ("TRUE", "Figures", "'as supplied'", "'none is a benchmark or an estimate'")],
    }
    parts = [f"SELECT feature_id, '{section}' AS section, {k} AS k, '{label}' AS label, {value} AS value, {note} AS note FROM pf, win WHERE {when}" for section, own in rows.items() for k, (when, label, value, note) in enumerate(own)]
    return "SELECT feature_id, section, CAST(row_number() OVER (PARTITION BY feature_id, section ORDER BY k) - 1 AS INTEGER) AS place, label, value, note FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL"


def oracle_sql() -> dict[str, str]:
    from seatmetrics import oracles
    from seatmetrics.plans.coverage import CAPABILITY_NAMES, INPUT_NAMES

    with_all = _DATA + ", " + _needs() + ", given AS (SELECT list_filter(['usage', CASE WHEN has_concurrency THEN 'concurrency' END, 'entitlements', CASE WHEN priced_contracts > 0 THEN 'cost' END, CASE WHEN resolved_people > 0 THEN 'people' END, CASE WHEN dated_contracts > 0 THEN 'contractDates' END], lambda x: x IS NOT NULL) AS present, distinct_dates FROM cov, facts)"
    some = _DATA + ", " + _needs() + ", given AS (SELECT list_filter(['usage', CASE WHEN has_concurrency THEN 'concurrency' END, 'entitlements'], lambda x: x IS NOT NULL) AS present, distinct_dates FROM cov, facts)"
    lack = ", lack AS (SELECT place, capability, list_filter(need, lambda x: NOT list_contains(present, x)) AS missing, distinct_dates >= 14 OR capability NOT IN ('percentileDemand', 'recommendedRenewalSpend') AS enough FROM needs, given)"
    many = lambda x: f"format('{{:,}}', {x})"
    part = lambda n: f"CASE WHEN contracts_records > {n} THEN 'partial' ELSE 'complete' END"
    return {
        "header_mapping": _COLUMNS,
        "source_detection": "SELECT file, source, CAST(confidence AS INTEGER) AS confidence FROM (SELECT 'daemon' AS file, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'flexnet' ELSE 'generic' END AS source, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 55 ELSE 0 END AS confidence FROM events UNION ALL SELECT 'plain', CASE WHEN count(*) FILTER (WHERE event_type LIKE '%lmgrd%') > 0 THEN 'flexnet' ELSE 'generic' END, CASE WHEN count(*) FILTER (WHERE event_type LIKE '%lmgrd%') > 0 THEN 55 ELSE 0 END FROM events UNION ALL SELECT 'tokens', 'dsls', least(99, 95 + 60 * count(*) FILTER (WHERE event_type LIKE '%dsls%')) FROM events)",
        "mixed_sources": _MIXED + "SELECT source, denied, count(*) AS rows, count(DISTINCT k) AS features, CAST(sum(k) AS DOUBLE) AS concurrent, min(CAST(ts AS DATE)) AS first_date FROM ok GROUP BY ALL",
        "source_quality": _quality(),
        "source_models": "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'node_locked' WHEN 1 THEN 'named_user' WHEN 2 THEN 'concurrent' WHEN 3 THEN 'token' WHEN 4 THEN CASE WHEN p_size % 2 = 0 THEN 'named_user' ELSE 'token' END ELSE 'node_locked' END AS license_model FROM part",
        "methodology": oracles.sql("SELECT feature_id, 'P95 of daily peaks × 1.00 growth × 1.10 safety, rounded up. Basis ' || format('{:,.2f}', floor(b * 100 + 0.5) / 100) || ' from ' || format('{:,}', n) || ' days.' AS methodology FROM (SELECT feature_id, round(quantile_cont(peak, 0.95), 6) AS b, count(*) AS n FROM daily JOIN feat USING (feature_id), win WHERE date BETWEEN d0 AND d1 GROUP BY feature_id)"),
        "synthetic_peaks": "SELECT p_brand AS feature_id, CAST(floor(sum(p_size) / 2.0) AS DOUBLE) AS p95, CAST(sum(p_size) AS DOUBLE) AS highest, CAST(365 AS BIGINT) AS days FROM part GROUP BY ALL",
        "estate_coverage": _DATA + "SELECT * FROM cov",
        "estate_lines": _DATA
        + f"SELECT CAST(place AS INTEGER) AS place, label, state, detail FROM (SELECT unnest(range(0, 9)) AS place, unnest(['Usage', 'Concurrent demand', 'Entitlements', 'People', 'Denials', 'Contracts', 'Renewal dates', 'Cost', 'Currency']) AS label, "
        f"unnest(['complete', CASE WHEN has_concurrency THEN 'complete' ELSE 'not_supplied' END, 'complete', CASE WHEN resolved_people < distinct_users THEN 'partial' ELSE 'complete' END, 'not_supplied', 'complete', {part('dated_contracts')}, {part('priced_contracts')}, CASE WHEN contains(currencies, '|') THEN 'partial' ELSE 'complete' END]) AS state, "
        f"unnest([{many('usage_records')} || ' records', CASE WHEN has_concurrency THEN 'Available' ELSE 'Not supplied by the source' END, {many('entitlements_records')} || ' records', {many('resolved_people')} || ' of ' || {many('distinct_users')} || ' usernames resolved', 'Denial data not supplied', {many('contracts_records')} || ' commercial lines', {many('dated_contracts')} || ' of ' || {many('contracts_records')} || ' lines dated', {many('priced_contracts')} || ' of ' || {many('contracts_records')} || ' lines priced', CASE WHEN contains(currencies, '|') THEN 'Mixed: ' || replace(currencies, '|', ', ') || ' — amounts are not summed across currencies' ELSE currencies END]) AS detail FROM cov, facts)",
        "unlock_suggestions": some + lack + f" SELECT CAST(place AS INTEGER) AS place, {_labels(CAPABILITY_NAMES)}[capability] AS capability, 'Add ' || array_to_string(list_transform(missing, lambda x: {_labels(INPUT_NAMES)}[x]), ' and ') AS needs FROM lack WHERE len(missing) > 0",
        "unlock_ranking": some + lack + ", one AS (SELECT place, capability, unnest(missing) AS input, len(missing) = 1 AND enough AS opened FROM lack), g AS (SELECT input, count(*) FILTER (WHERE opened) AS unlocks, count(*) FILTER (WHERE NOT opened) AS helps, coalesce(string_agg(capability, '|' ORDER BY place) FILTER (WHERE opened), '') AS capabilities FROM one GROUP BY input) SELECT *, CAST(row_number() OVER (ORDER BY unlocks DESC, helps DESC, input) AS INTEGER) AS rank FROM g",
        "quality_band": with_all + lack + ", m AS (SELECT count(*) FILTER (WHERE capability IN ('usageTrends', 'dailyDemand', 'percentileDemand') AND len(missing) = 0 AND enough) AS met FROM lack) SELECT CASE WHEN met = 3 THEN 'High' WHEN met > 0 THEN 'Medium' ELSE 'Low' END AS band, met FROM m",
        "confirmation_state": _DECISIONS + "SELECT kind, raw, target, decision, decided_at, changes FROM s WHERE place = 1 AND NOT undo",
        "confirmed_aliases": _DECISIONS + "SELECT raw, target FROM s WHERE place = 1 AND NOT undo AND kind = 'feature' AND decision = 'confirmed'",
        "undone_confirmations": _DECISIONS + "SELECT kind, raw, max(decided_at) FILTER (WHERE undo) AS undone_at FROM s GROUP BY kind, raw HAVING count(*) FILTER (WHERE NOT undo) > 0 AND bool_or(place = 1 AND undo)",
        "sliced_insert": "WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS n, 'part ' || min(l_partkey) AS f, sum(l_quantity) AS q, min(CASE WHEN l_linenumber > 1 THEN l_suppkey END) AS p FROM lineitem GROUP BY 1), a AS (SELECT f, q, p, min(n) AS n FROM r GROUP BY f, q, p) SELECT CASE WHEN n % 3 <> 0 THEN 'one' ELSE 'two' END AS import_id, count(*) AS rows, sum(q) AS quantity, min(n) AS first_row FROM a GROUP BY ALL",
        "evidence_clauses": oracles.sql(_clauses()),
        "questions_understood": "SELECT p_partkey AS question_id, CASE n WHEN 0 THEN 'capacity' WHEN 1 THEN 'capacity' WHEN 2 THEN 'scenario' WHEN 3 THEN 'spend' ELSE 'renewal' END AS intent, CASE n WHEN 0 THEN 'capacity_risk' WHEN 1 THEN 'capacity_risk' WHEN 2 THEN 'scenario_rollup' WHEN 3 THEN 'portfolio_totals' ELSE 'renewal_priority' END AS query, CASE n WHEN 2 THEN CAST(p_partkey % 40 AS DOUBLE) END AS percent, CASE WHEN n IN (0, 2) THEN p_name END AS name, CASE WHEN n IN (0, 2) THEN 'p_name' END AS column, CASE WHEN n IN (0, 2) THEN p_name END AS value, CASE n WHEN 1 THEN 'catia' || p_partkey WHEN 3 THEN 'TOOL_' || p_partkey END AS unknown, CASE WHEN n IN (1, 3) THEN 'unknown subject' ELSE 'answer' END AS status FROM (SELECT *, p_partkey % 5 AS n FROM part)",
        "keyset_read": "SELECT o_orderstatus, count(*) AS orders, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total FROM orders WHERE o_orderkey > 100 GROUP BY ALL",
    }
