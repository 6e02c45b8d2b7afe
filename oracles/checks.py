"""One SQL text per query name."""

from __future__ import annotations

import re

from .pieces import (
    EFFECTIVE,
    FAILED,
    KEY,
    MONTH,
    SUCCESS,
    WEEK,
    assemble,
    budget_advice,
    category,
    cluster_advice,
    fixed,
    key_text,
    load_percent,
    reason_advice,
    rounded,
    sla_advice,
    spike_advice,
    text,
    trend,
)

NAMED = "COALESCE(t.name, 'job-' || CAST(job_id AS VARCHAR)) AS job_name"
DURATIONS = ["median_duration_seconds", "p90_duration_seconds", "avg_duration_seconds", "max_duration_seconds"]
STREAMING_NAME = r"(stream|\bcdc\b|continuous|real.?time|kafka|kinesis|event.?hub|ingest|pipeline)"


def _health_list(days: int) -> str:
    short = "7" if days == 7 else "30"
    return f"""
SELECT {KEY}, {NAMED}, total_runs, success_count, success_rate, last_run_time, last_duration_seconds, priority, status,
  retry_count, COALESCE(open_runs, 0) AS open_runs
FROM health{short} LEFT JOIN tags t USING ({KEY}) LEFT JOIN retries{short} USING ({KEY}) LEFT JOIN open{short} USING ({KEY})"""


def _health_read(days: int) -> str:
    window = "health7" if days == 7 else "health30"
    return rounded(
        f"""
SELECT {KEY}, {NAMED}, w.total_runs, w.success_count, w.success_rate, m.last_run_time, m.last_duration_seconds,
  h.priority, COALESCE(r.retry_count, 0) AS retry_count, {', '.join(DURATIONS)}
FROM {window} w JOIN health30 m USING ({KEY}) LEFT JOIN health7 h USING ({KEY}) LEFT JOIN retries7 r USING ({KEY})
LEFT JOIN stats_raw USING ({KEY}) LEFT JOIN tags t USING ({KEY})""",
        *DURATIONS,
    )


def _cost_series(days: int, weekly: bool = False, team: bool = False) -> str:
    first, second = f"DATE '2024-01-31' - {days}", f"DATE '2024-01-31' - {2 * days}"
    start = f"(DATE '2024-01-31' - {days})"
    bucket = f"CAST({start} + CAST(FLOOR((d - {start}) / 7.0) AS INTEGER) * 7 AS DATE)" if weekly else "CAST(d AS DATE)"
    only = f" AND (workspace_id, TRY_CAST(job_id AS BIGINT)) IN (SELECT ({KEY}) FROM tags WHERE team = 'building')" if team else ""
    return f"""
SELECT COALESCE(c.period, p.period) AS period, CAST(COALESCE(c.v, 0) AS DOUBLE) AS "current", CAST(COALESCE(p.v, 0) AS DOUBLE) AS previous
FROM (SELECT {bucket} AS period, SUM(q) AS v FROM (SELECT usage_date AS d, usage_quantity AS q FROM usage
  WHERE TRY_CAST(job_id AS BIGINT) IS NOT NULL AND usage_date >= {first} AND usage_date <= DATE '2024-01-31'{only}) x GROUP BY 1) c
FULL OUTER JOIN (SELECT {bucket} AS period, SUM(q) AS v FROM (SELECT usage_date + {days} AS d, usage_quantity AS q FROM usage
  WHERE TRY_CAST(job_id AS BIGINT) IS NOT NULL AND usage_date >= {second} AND usage_date < {first}{only}) x GROUP BY 1) p ON c.period = p.period"""


def _run_series(days: int, measure: str, bucket: str, where: str = "", team: bool = False) -> str:
    first, second = f"DATE '2024-01-31' - {days}", f"DATE '2024-01-31' - {2 * days}"
    only = f" AND ({KEY}) IN (SELECT ({KEY}) FROM tags WHERE team = 'building')" if team else ""
    base = "SELECT {moment} AS ts, result_state FROM runs WHERE result_state IS NOT NULL" + where + only
    now = base.format(moment="period_start_time") + f" AND period_start_time >= {first} AND period_start_time < DATE '2024-02-01'"
    before = (
        base.format(moment=f"period_start_time + INTERVAL '{days}' DAY")
        + f" AND period_start_time >= {second} AND period_start_time < {first}"
    )
    return f"""
SELECT COALESCE(c.period, p.period) AS period, c.v AS "current", p.v AS previous
FROM (SELECT {bucket} AS period, {measure} AS v FROM ({now}) x GROUP BY 1) c
FULL OUTER JOIN (SELECT {bucket} AS period, {measure} AS v FROM ({before}) x GROUP BY 1) p ON c.period = p.period"""


BASELINE_ROWS = f"""
SELECT {KEY}, quantile_cont(CAST(dbus AS DOUBLE), 0.9) AS p90 FROM (SELECT workspace_id, TRY_CAST(job_id AS BIGINT) AS job_id, usage_date,
    SUM(usage_quantity) AS dbus FROM usage WHERE usage_date >= DATE '2024-01-01' AND usage_date <= DATE '2024-01-31'
    AND TRY_CAST(job_id AS BIGINT) IS NOT NULL GROUP BY 1, 2, 3) d WHERE dbus {{sign}} 0 GROUP BY 1, 2 HAVING COUNT(*) >= 5"""


def _job_costs(days: int) -> str:
    """The cost table over another window, from the raw usage rows."""
    return f"""
SELECT {KEY}, {NAMED}, t.team, CAST(total AS DOUBLE) AS total_dbus_30d, CAST(cur AS DOUBLE) AS current_7d_dbus,
  CAST(prev AS DOUBLE) AS prev_7d_dbus, {trend('cur', 'prev')} AS trend_7d_percent, sku_breakdown, p90 AS baseline_p90_dbus,
  COALESCE(cur > 0 AND p90 > 0 AND CAST(cur AS DOUBLE) > 2 * p90, FALSE) AS is_anomaly, CAST(total AS DOUBLE) * 0.5 AS total_cost_dollars
FROM (SELECT {KEY}, SUM(total) AS total, SUM(cur) AS cur, SUM(prev) AS prev,
    STRING_AGG(sku_name || ':' || CAST(CAST(total AS DECIMAL(28,5)) AS VARCHAR), ',' ORDER BY sku_name) AS sku_breakdown
  FROM (SELECT workspace_id, TRY_CAST(job_id AS BIGINT) AS job_id, sku_name,
      SUM(CASE WHEN usage_date >= DATE '2024-01-31' - {days} THEN usage_quantity ELSE 0 END) AS total,
      SUM(CASE WHEN usage_date >= DATE '2024-01-24' THEN usage_quantity ELSE 0 END) AS cur,
      SUM(CASE WHEN usage_date >= DATE '2024-01-17' AND usage_date < DATE '2024-01-24' THEN usage_quantity ELSE 0 END) AS prev
    FROM usage WHERE usage_date <= DATE '2024-01-31' AND TRY_CAST(job_id AS BIGINT) IS NOT NULL GROUP BY 1, 2, 3) p
  WHERE total <> 0 GROUP BY 1, 2) j
LEFT JOIN tags t USING ({KEY}) LEFT JOIN ({BASELINE_ROWS.format(sign='<>')}) b USING ({KEY})"""


MOVED = {
    "2024-01-31": "2001-06-30", "2024-02-01": "2001-07-01", "2024-01-24": "2001-06-23", "2024-01-17": "2001-06-16",
    "2024-01-01": "2001-05-31", "2023-12-02": "2001-05-01",
}


def _long(sql: str) -> str:
    """The same check over the source of several years and its check day."""
    sql = re.sub(r"FROM (runs|usage)\b", r"FROM long_\1", sql)
    return re.sub("|".join(MOVED), lambda m: MOVED[m[0]], sql)


def _runs_within(days: int, columns: str) -> str:
    return f"""SELECT {KEY}, {columns} FROM runs WHERE period_start_time >= DATE '2024-01-31' - {days}
  AND period_start_time < DATE '2024-02-01' GROUP BY 1, 2 HAVING COUNT(*) FILTER (WHERE result_state IS NOT NULL) > 0"""


FINISHED = "COUNT(*) FILTER (WHERE result_state IS NOT NULL)"
GOOD = f"COUNT(*) FILTER (WHERE {SUCCESS})"
LONG_ANOMALIES = f"""
SELECT {KEY}, job_name, team, kind AS anomaly_type, CASE WHEN kind = 'cost_spike'
    THEN 'Cost ' || {fixed('current_7d_dbus / baseline_p90_dbus', 1)} || 'x higher than p90 baseline'
    WHEN n > 0 AND ok = 0 THEN 'High cost (' || {fixed('total_dbus_30d', 1)} || ' DBUs) with 0 successful runs out of ' || {text('n')} || ' attempts'
    WHEN n = 0 THEN 'High cost (' || {fixed('total_dbus_30d', 1)} || ' DBUs) with no detected runs'
    ELSE 'High cost per run (' || {fixed('total_dbus_30d / n', 1)} || ' DBUs/run) may indicate inefficiency' END AS reason,
  CASE WHEN kind = 'cost_spike' THEN current_7d_dbus ELSE total_dbus_30d END AS current_dbus,
  CASE WHEN kind = 'cost_spike' THEN baseline_p90_dbus END AS baseline_p90_dbus,
  CASE WHEN kind = 'cost_spike' THEN current_7d_dbus / baseline_p90_dbus END AS multiplier
FROM (SELECT c.*, COALESCE(n, 0) AS n, COALESCE(ok, 0) AS ok, CASE WHEN is_anomaly THEN 'cost_spike'
    WHEN total_dbus_30d > 10 AND (COALESCE(ok, 0) = 0 OR total_dbus_30d / n > 5) THEN 'zombie' END AS kind
  FROM ({_job_costs(90)}) c LEFT JOIN ({_runs_within(90, f'{FINISHED} AS n, {GOOD} AS ok')}) r USING ({KEY})) x WHERE kind IS NOT NULL"""
LONG_SPIKES = f"""
SELECT {KEY}, {NAMED}, CAST(week AS DOUBLE) / 8 AS current_dbus, p90 AS baseline_p90_dbus, CAST(week AS DOUBLE) / 8 / p90 AS multiplier
FROM (SELECT workspace_id, TRY_CAST(job_id AS BIGINT) AS job_id, SUM(usage_quantity) AS week FROM usage
  WHERE usage_date >= DATE '2024-01-24' AND usage_date <= DATE '2024-01-31' AND TRY_CAST(job_id AS BIGINT) IS NOT NULL GROUP BY 1, 2) w
JOIN ({BASELINE_ROWS.format(sign='>')}) b USING ({KEY}) LEFT JOIN tags t USING ({KEY}) WHERE CAST(week AS DOUBLE) / 8 > 2 * p90"""
USAGE_DAYS = """SELECT workspace_id, usage_date, job_id, cluster_id, sku_name, CAST(SUM(usage_quantity) AS DOUBLE) AS total_dbus FROM usage
WHERE usage_date >= DATE '2024-01-01' AND usage_date <= DATE '2024-01-31' GROUP BY ALL HAVING SUM(usage_quantity) <> 0"""
RATE_OF = f"COUNT(*) FILTER (WHERE {SUCCESS}) * 100.0 / CAST(COUNT(*) AS DOUBLE)"
HOUR = "CAST(DATE_TRUNC('hour', ts) AS TIMESTAMP)"
DAY = "CAST(CAST(ts AS DATE) AS TIMESTAMP)"
WEEK60 = "CAST(DATE '2023-12-02' + CAST(FLOOR((CAST(ts AS DATE) - DATE '2023-12-02') / 7.0) AS INTEGER) * 7 AS TIMESTAMP)"
SUCCESS_SERIES = _run_series(7, RATE_OF, HOUR)
FAILURE_SERIES = f"""
SELECT period, COALESCE("current", 0) AS "current", COALESCE(previous, 0) AS previous
FROM ({_run_series(14, "COUNT(*)", DAY, f" AND {FAILED}")}) f"""
COST_SERIES = _cost_series(14)
DETAIL_RUNS = f"""
SELECT {KEY}, STRING_AGG(CAST(run_id AS VARCHAR) || ':' || COALESCE(result_state, '-') || ':' || COALESCE(CAST(s AS VARCHAR), '-')
    || ':' || CAST(COALESCE(median_duration_seconds > 0 AND s > 2 * median_duration_seconds, FALSE) AS VARCHAR),
    ';' ORDER BY rn) AS recent_runs
FROM (SELECT {KEY}, run_id, result_state, {EFFECTIVE} AS s,
    ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY period_start_time DESC, run_id DESC) AS rn FROM runs WHERE {MONTH}) x
LEFT JOIN stats_effective USING ({KEY}) WHERE rn <= 10 GROUP BY {KEY}"""
PRIORITY_RANK = "CASE {c} WHEN 'P1' THEN 1 WHEN 'P2' THEN 2 WHEN 'P3' THEN 3 ELSE 4 END"
HEALTH_COUNTS = """COUNT(*) FILTER (WHERE priority = 'P1') AS p1_count, COUNT(*) FILTER (WHERE priority = 'P2') AS p2_count,
  COUNT(*) FILTER (WHERE priority = 'P3') AS p3_count, COUNT(*) FILTER (WHERE priority IS NULL) AS healthy_count"""
MEAN_RATE = "CAST(SUM(CAST(success_rate AS DECIMAL(10,1))) AS DOUBLE) / COUNT(*)"
TEAM_ROWS = """SELECT team, total_dbus_30d, job_count, ROUND(total_dbus_30d / total * 100, 2) AS percent_of_total, trend_7d_percent
FROM (SELECT *, (SELECT CAST(SUM(CAST(total_dbus_30d AS DECIMAL(28,5))) AS DOUBLE) FROM team_rows) AS total FROM team_rows) x"""
PAIR_LIST = "STRING_AGG(column_name, ',' ORDER BY column_name) FILTER (WHERE {c})"
BOTH = "table_name IN (SELECT table_name FROM column_snapshots WHERE snapshot_version = 1)"
RETYPED = "NOT fresh AND NOT gone AND old_type <> new_type"
LAST_STATES = f"""SELECT {KEY}, last_state, previous_state, last_failed, last_failed AND COALESCE(previous_state IN ('FAILED', 'FAILURE'), FALSE) AS consecutive_failure
FROM (SELECT {KEY}, UPPER(result_state) AS last_state, UPPER(prev_state) AS previous_state, {FAILED} AS last_failed
  FROM (SELECT {KEY}, result_state, LAG(result_state) OVER (PARTITION BY {KEY} ORDER BY period_start_time, run_id) AS prev_state,
      ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY period_start_time DESC, run_id DESC) AS rn
    FROM runs WHERE result_state IS NOT NULL{{window}}) q WHERE rn = 1) z"""


def _grouped(value: str, places: int) -> str:
    """Rounded value with thousands separators and no decimals."""
    return f"format('{{:,}}', CAST(ROUND({value}, {places}) AS BIGINT))"


USAGE_TEXT = (
    f"CASE WHEN total_dbus_30d < 0.01 THEN '<0.01' WHEN total_dbus_30d < 1 THEN {fixed('total_dbus_30d', 2)} "
    f"WHEN total_dbus_30d < 10 THEN {fixed('total_dbus_30d', 1)} ELSE {_grouped('total_dbus_30d', 0)} END"
)
COST_TEXT = f"'$' || CASE WHEN cash < 1 THEN {fixed('cash', 2)} ELSE {_grouped('cash', 0)} END"


def _span_text(seconds: str) -> str:
    s = f"CAST(FLOOR({seconds}) AS BIGINT)"
    h, m = f"({s} // 3600)", f"(({s} % 3600) // 60)"
    return (
        f"CASE WHEN {seconds} IS NULL OR {seconds} < 0 THEN '--' WHEN {h} > 0 AND {m} > 0 THEN {text(h)} || 'h ' || {text(m)} || 'm' "
        f"WHEN {h} > 0 THEN {text(h)} || 'h' WHEN {m} > 0 THEN {text(m)} || 'm' ELSE {text(f'{s} % 60')} || 's' END"
    )


def _count_text(n: str) -> str:
    return (
        f"CASE WHEN {n} >= 1000000000 THEN {fixed(f'{n} / 1000000000.0', 1)} || 'B' "
        f"WHEN {n} >= 1000000 THEN {fixed(f'{n} / 1000000.0', 1)} || 'M' "
        f"WHEN {n} >= 1000 THEN {fixed(f'{n} / 1000.0', 1)} || 'K' ELSE {text(n)} END"
    )


PRESET_RANGE = """CASE WHEN time_range = 'custom' AND start_date IS NOT NULL THEN CAST(start_date AS DATE)
    ELSE CAST(COALESCE(CAST(end_date AS DATE), DATE '2024-01-31') - CASE time_range WHEN '30d' THEN 30 WHEN '90d' THEN 90 ELSE 7 END AS DATE) END"""

PRESET_JOBS = f"""
SELECT p.id AS preset_id, j.workspace_id, j.job_id, j.name AS job_name, {PRESET_RANGE} AS range_start,
  COALESCE(CAST(p.end_date AS DATE), DATE '2024-01-31') AS range_end
FROM presets p JOIN tags j ON (p.team IS NULL OR p.team = j.team) AND (p.job_id IS NULL OR p.job_id = CAST(j.job_id AS VARCHAR))
  AND (p.job_name_patterns = '' OR EXISTS (SELECT 1 FROM (SELECT UNNEST(string_split(p.job_name_patterns, ',')) AS pattern) u
    WHERE j.name ILIKE REPLACE(REPLACE(REPLACE(pattern, '_', '\\_'), '*', '%'), '?', '_') ESCAPE '\\'))"""

BODIES: dict[str, str] = {
    "list_runs": f"""
SELECT {KEY}, run_id, period_start_time, period_end_time, run_duration_seconds, result_state FROM runs WHERE {WEEK}
""",
    "newest_runs": f"""
SELECT {KEY}, run_id, period_start_time, period_end_time, run_duration_seconds, result_state FROM runs WHERE {WEEK}
ORDER BY period_start_time DESC, run_id DESC LIMIT 1000""",
    "list_jobs": f"SELECT {KEY}, name, creator_user_name FROM latest",
    "first_jobs": f"SELECT {KEY}, name, creator_user_name FROM latest ORDER BY name, workspace_id, job_id LIMIT 1000",
    "usage_daily": rounded(USAGE_DAYS, "total_dbus"),
    "usage_daily_top": rounded(
        USAGE_DAYS + "\nORDER BY usage_date DESC, total_dbus DESC, workspace_id, job_id NULLS LAST, cluster_id, sku_name LIMIT 1000",
        "total_dbus",
    ),
    "unreadable_job_ids": """
SELECT workspace_id, job_id AS job_id_text, COUNT(*) AS usage_rows FROM usage
WHERE job_id IS NOT NULL AND NOT regexp_full_match(job_id, '[0-9]+') GROUP BY 1, 2""",
    "job_output_tables_first": f"""
SELECT {KEY}, table_name FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY table_name) AS rn FROM lineage_tables) x WHERE rn <= 5""",
    "job_output_tables": "SELECT * FROM lineage_tables",
    "job_output_tables_fallback": "SELECT * FROM output_lists",
    "table_name_parts": f"""
SELECT {KEY}, table_name, CASE WHEN n = 3 THEN p[1] END AS catalog_part,
  CASE WHEN n = 3 THEN p[2] ELSE p[1] END AS schema_part, p[n] AS table_part
FROM (SELECT *, string_split(table_name, '.') AS p, len(string_split(table_name, '.')) AS n FROM output_lists) x
WHERE n IN (2, 3)""",
    "active_runs": f"SELECT {KEY}, run_id, period_start_time FROM runs WHERE period_end_time IS NULL",
    "job_tags": rounded(
        f"""SELECT {KEY}, sla_minutes, team, owner, budget_monthly_dbus, sla_minutes IS NOT NULL AS has_sla, team IS NOT NULL AS has_team FROM tags""",
        "budget_monthly_dbus",
    ),
    "epoch_ms_to_ts": f"""
SELECT {KEY}, run_id, CASE WHEN period_end_time IS NULL THEN 'RUNNING' ELSE 'TERMINATED' END AS state, result_state,
  CAST(DATE_TRUNC('milliseconds', period_start_time) AS TIMESTAMP) AS start_time,
  CAST(DATE_TRUNC('milliseconds', period_end_time) AS TIMESTAMP) AS end_time FROM runs""",
    "refresh_rollups": """
SELECT 'job_health' AS rollup, COUNT(*) AS rows_written FROM health30 UNION ALL SELECT 'cost', COUNT(*) FROM costs
UNION ALL SELECT 'alerts', (SELECT COUNT(*) FROM failure_alerts) + (SELECT COUNT(*) FROM spike_alerts)""",
    "read_health_rollup": _health_read(7),
    "read_health_rollup_30d": _health_read(30),
    "read_cost_rollup": rounded(
        "SELECT * FROM costs",
        "total_dbus_30d", "current_7d_dbus", "prev_7d_dbus", "baseline_p90_dbus", "total_cost_dollars",
    ),
    "read_cost_rollup_top": rounded(
        "SELECT * FROM costs ORDER BY total_dbus_30d DESC, workspace_id, job_id LIMIT 500",
        "total_dbus_30d", "current_7d_dbus", "prev_7d_dbus", "baseline_p90_dbus", "total_cost_dollars",
    ),
    "rollup_schema_evolution": rounded(
        "SELECT * REPLACE (CASE WHEN workspace_id <> 1000 THEN trend_7d_percent END AS trend_7d_percent) FROM costs",
        "total_dbus_30d", "current_7d_dbus", "prev_7d_dbus", "baseline_p90_dbus", "total_cost_dollars",
    ),
    "catalog_refresh": rounded(
        "SELECT * FROM costs",
        "total_dbus_30d", "current_7d_dbus", "prev_7d_dbus", "baseline_p90_dbus", "total_cost_dollars",
    ),
    "read_alerts_rollup": """
SELECT * FROM failure_alerts WHERE workspace_id = 1001 UNION ALL SELECT * FROM spike_alerts WHERE workspace_id = 1001""",
    "read_duration_rollup": rounded(
        f"""SELECT {KEY}, {', '.join(DURATIONS)}, total_runs AS run_count FROM health30 LEFT JOIN stats_raw USING ({KEY})
WHERE ({KEY}) IN (SELECT ({KEY}) FROM tags WHERE team = 'building')""",
        *DURATIONS,
    ),
    "rollup_freshness": """
SELECT MAX(last_run_time) AS refreshed_at, MAX(last_run_time) > TIMESTAMP '2024-01-30 23:00:00' AS is_fresh FROM health7""",
    "list_presets": "SELECT * FROM presets WHERE is_shared",
    "apply_preset_changes": """
SELECT * REPLACE (CASE WHEN time_range = '90d' THEN '30d' ELSE time_range END AS time_range),
  CASE WHEN time_range = '90d' THEN 'batch' END AS created_by FROM presets WHERE is_shared""",
    "window_filter": f"SELECT {KEY}, run_id FROM runs WHERE {WEEK}",
    "custom_window_filter": f"""
SELECT {KEY}, run_id FROM runs WHERE period_start_time >= DATE '2024-01-11' AND period_start_time < DATE '2024-01-21'""",
    "workspace_filter": f"SELECT {KEY}, run_id FROM runs WHERE workspace_id = 1001",
    "run_outcomes": f"""
SELECT {KEY}, run_id, result_state, CASE WHEN result_state IS NULL THEN 'open' WHEN {SUCCESS} THEN 'success'
  WHEN {FAILED} THEN 'failed' ELSE 'other' END AS outcome FROM runs""",
    "effective_duration": f"""
SELECT * FROM (SELECT {KEY}, run_id, {EFFECTIVE} AS effective_seconds FROM runs
  WHERE result_state IS NOT NULL AND period_end_time IS NOT NULL) x WHERE effective_seconds > 0""",
    "name_patterns": f"""
SELECT {KEY}, name AS job_name FROM latest
WHERE name ILIKE 'etl-%' OR name ILIKE '%-daily' OR name ILIKE 'kafka_ingest-%'""",
    "validate_patterns": r"""
SELECT id, pattern, CASE WHEN TRIM(pattern) = '' THEN 'Pattern cannot be empty'
  WHEN LENGTH(pattern) > 100 THEN 'Pattern is too long (max 100 characters)'
  WHEN regexp_matches(pattern, '[<>|&;`$]') THEN 'Pattern contains invalid characters' END AS message
FROM (SELECT id, UNNEST(string_split(job_name_patterns, ',')) AS pattern FROM presets) x""",
    "recent_jobs": f"""
SELECT {KEY}, {NAMED}, last_run_time FROM health7 LEFT JOIN tags t USING ({KEY})
WHERE last_run_time >= TIMESTAMP '2024-01-30 18:00:00'""",
    "search_jobs": f"""
SELECT * FROM (SELECT {KEY}, {NAMED} FROM health7 LEFT JOIN tags t USING ({KEY})) x
WHERE job_name ILIKE '%etl%' OR CAST(job_id AS VARCHAR) LIKE '%etl%'""",
    "search_alerts": """
SELECT condition_key, title FROM feed WHERE job_name ILIKE '%budget%' OR title ILIKE '%budget%'
  OR description ILIKE '%budget%' OR category ILIKE '%budget%'""",
    "filter_alerts": """
SELECT condition_key, severity, category FROM feed
WHERE severity IN ('P1', 'P2') AND category IN ('failure', 'cost') AND NOT acknowledged""",
    "filter_active_state": "SELECT * FROM active_runs WHERE state IN ('PENDING', 'QUEUED')",
    "job_status": f"SELECT {KEY}, success_rate, status FROM health7",
    "job_priority": f"SELECT {KEY}, success_rate, priority FROM health7",
    "sku_category": f"SELECT sku_name, COUNT(*) AS usage_rows, {category('sku_name')} AS sku_category FROM usage GROUP BY sku_name",
    "streaming_jobs": f"SELECT {KEY}, name, regexp_matches(name, '{STREAMING_NAME}', 'i') AS is_streaming FROM latest",
    "long_running": f"""
SELECT {KEY}, run_id, job_name, elapsed_seconds, is_streaming,
  elapsed_seconds > CASE WHEN is_streaming THEN 86400 ELSE 14400 END AS is_long_running
FROM (SELECT {KEY}, run_id, job_name, date_sub('second', start_time, TIMESTAMP '2024-01-31 00:00:00') AS elapsed_seconds,
    regexp_matches(job_name, '{STREAMING_NAME}', 'i') AS is_streaming
  FROM (SELECT {KEY}, run_id, start_time, {NAMED} FROM active_runs LEFT JOIN tags t USING ({KEY})) y) x""",
    "runs_for_jobs": f"SELECT {KEY}, run_id FROM runs WHERE ({KEY}) IN (SELECT ({KEY}) FROM tags WHERE team = 'building')",
    "duration_anomalies": rounded(
        f"""SELECT {KEY}, run_id, period_start_time, s AS duration_seconds, median_duration_seconds AS baseline_median_seconds
FROM effective JOIN stats_effective USING ({KEY}) WHERE median_duration_seconds > 0 AND s > 2 * median_duration_seconds""",
        "baseline_median_seconds",
    ),
    "apply_presets": PRESET_JOBS,
    "apply_chosen_presets": PRESET_JOBS + " WHERE p.id IN ('1', '2', '4', '10')",
    "utilization_label": f"""
SELECT {KEY}, w AS worker_cpu_percent, CASE WHEN w IS NULL THEN 'No data' WHEN w >= 60 THEN 'Efficient' WHEN w >= 40 THEN 'Fair'
  ELSE 'Low' END AS label FROM cluster_rows""",
    "run_names": f"SELECT {KEY}, run_id, {NAMED} FROM runs LEFT JOIN tags t USING ({KEY})",
    "cost_spikes": rounded(
        f"""SELECT {KEY}, {NAMED}, current_dbus, baseline_p90_dbus, multiplier FROM spikes LEFT JOIN tags t USING ({KEY})""",
        "current_dbus", "baseline_p90_dbus", "multiplier",
    ),
    "top_cost_spikes": rounded(
        f"""SELECT {KEY}, {NAMED}, current_dbus, baseline_p90_dbus, multiplier FROM spikes LEFT JOIN tags t USING ({KEY})
ORDER BY ROUND(multiplier, 9) DESC, workspace_id, job_id LIMIT 50""",
        "current_dbus", "baseline_p90_dbus", "multiplier",
    ),
    "cost_spikes_daily_mean": rounded(
        f"""SELECT {KEY}, {NAMED}, CAST(week AS DOUBLE) / 8 AS current_dbus, p90 AS baseline_p90_dbus, CAST(week AS DOUBLE) / 8 / p90 AS multiplier
FROM week_spend JOIN baseline_positive USING ({KEY}) LEFT JOIN tags t USING ({KEY}) WHERE CAST(week AS DOUBLE) / 8 > 2 * p90""",
        "current_dbus", "baseline_p90_dbus", "multiplier",
    ),
    "run_dbu_rate": rounded("SELECT * FROM run_rates", "avg_dbus_per_hour"),
    "run_dbu_rate_allocated": rounded(
        f"""SELECT e.workspace_id, e.job_id, AVG(COALESCE(CAST(d.dbus AS DOUBLE), 0) * (e.s / e.day_s) / (e.s / 3600.0)) AS avg_dbus_per_hour,
  COUNT(DISTINCT e.run_id) AS runs_analyzed
FROM (SELECT *, CAST(period_start_time AS DATE) AS day, CAST(SUM(s) OVER (PARTITION BY {KEY}, CAST(period_start_time AS DATE)) AS DOUBLE) AS day_s FROM effective) e
LEFT JOIN (SELECT * FROM daily WHERE dbus > 0) d ON e.workspace_id = d.workspace_id AND e.job_id = d.job_id AND e.day = d.usage_date
GROUP BY e.workspace_id, e.job_id HAVING COUNT(DISTINCT e.run_id) >= 3""",
        "avg_dbus_per_hour",
    ),
    "zombie_jobs": rounded(
        f"SELECT {KEY}, {NAMED}, total_dbus, run_count, success_count FROM zombies LEFT JOIN tags t USING ({KEY})", "total_dbus"
    ),
    "trend_cost_team": rounded(_cost_series(14, team=True), '"current"', "previous"),
    "budget_alerts": "SELECT * FROM budget_alerts",
    "ack_alerts": """
SELECT condition_key, a.acknowledged_at IS NOT NULL AS acknowledged, a.acknowledged_at
FROM failure_alerts LEFT JOIN valid_acks a USING (condition_key)""",
    "cost_anomalies": rounded("SELECT * FROM anomalies", "current_dbus", "baseline_p90_dbus", "multiplier"),
    "cost_anomalies_90d": rounded(_long(LONG_ANOMALIES), "current_dbus", "baseline_p90_dbus", "multiplier"),
    "cost_spikes_daily_mean_long": rounded(_long(LONG_SPIKES), "current_dbus", "baseline_p90_dbus", "multiplier"),
    "success_rate_90d": _long(_runs_within(90, f"{FINISHED} AS total_runs, {GOOD} AS success_count, ROUND(100.0 * CAST({GOOD} AS DOUBLE) / {FINISHED}, 1) AS success_rate")),
    "retry_counts_90d": _long(_runs_within(90, f"{FINISHED} - COUNT(DISTINCT CASE WHEN result_state IS NOT NULL THEN CAST(period_start_time AS DATE) END) AS retry_count")),
    "health_open_long": _long(_runs_within(30, f"{FINISHED} AS total_runs, COUNT(*) FILTER (WHERE period_end_time IS NULL) AS open_runs")),
    "recent_runs_by_job": f"""
SELECT {KEY}, COALESCE(l.recent_runs, '') AS recent_runs FROM (SELECT DISTINCT {KEY} FROM jobs) i LEFT JOIN (
  SELECT {KEY}, STRING_AGG(CAST(run_id AS VARCHAR) || ':' || result_state || ':' || CAST(duration_seconds AS VARCHAR), ';' ORDER BY rn) AS recent_runs
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY period_start_time DESC, run_id DESC) AS rn FROM spans) x
  WHERE rn <= 5 GROUP BY {KEY}) l USING ({KEY})""",
    "active_with_history": f"""
SELECT {KEY}, run_id, state, start_time, COALESCE(l.recent_runs, '') AS recent_runs FROM active_runs LEFT JOIN (
  SELECT {KEY}, STRING_AGG(CAST(run_id AS VARCHAR) || ':' || result_state, ';' ORDER BY rn) AS recent_runs
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY period_start_time DESC, run_id DESC) AS rn FROM runs
    WHERE result_state IS NOT NULL) x WHERE rn <= 5 GROUP BY {KEY}) l USING ({KEY})""",
    "run_stats": f"""
SELECT {KEY}, total_runs, success_count, failed_count, COALESCE(open_runs, 0) AS open_runs, last_run_time, last_duration_seconds
FROM health7 LEFT JOIN open7 USING ({KEY})""",
    "success_rate": f"SELECT {KEY}, total_runs, success_count, success_rate FROM health30",
    "retry_counts": f"SELECT {KEY}, CAST(retry_count AS BIGINT) AS retry_count FROM retries7",
    "retry_counts_distinct": f"""
SELECT {KEY}, GREATEST(COUNT(*) - COUNT(DISTINCT CAST(period_start_time AS DATE)), 0) AS retry_count
FROM runs WHERE result_state IS NOT NULL AND {WEEK} GROUP BY {KEY}""",
    "duration_stats": rounded("SELECT * FROM stats_raw", *DURATIONS),
    "suggested_sla": f"""
SELECT {KEY}, CAST(CEIL(p90_duration_seconds / 60) AS INTEGER) AS suggested_p90_minutes
FROM stats_effective JOIN tags USING ({KEY}) WHERE sla_minutes IS NULL AND has_sufficient_data""",
    "cost_job_sku": rounded(
        f"""SELECT {KEY}, sku_name, CAST(total_dbus AS DOUBLE) AS total_dbus, CAST(current_7d AS DOUBLE) AS current_7d,
  CAST(prev_7d AS DOUBLE) AS prev_7d FROM by_sku""",
        "total_dbus", "current_7d", "prev_7d",
    ),
    "cost_job": rounded(
        f"""SELECT {KEY}, CAST(total_dbus_30d AS DOUBLE) AS total_dbus_30d, CAST(current_7d_dbus AS DOUBLE) AS current_7d_dbus,
  CAST(prev_7d_dbus AS DOUBLE) AS prev_7d_dbus, sku_breakdown FROM by_job""",
        "total_dbus_30d", "current_7d_dbus", "prev_7d_dbus",
    ),
    "cost_trend": rounded(
        f"""SELECT {KEY}, CAST(current_7d_dbus AS DOUBLE) AS current_7d_dbus, CAST(prev_7d_dbus AS DOUBLE) AS prev_7d_dbus,
  {trend('current_7d_dbus', 'prev_7d_dbus')} AS trend_7d_percent FROM by_job""",
        "current_7d_dbus", "prev_7d_dbus",
    ),
    "cost_baseline": rounded(f"SELECT {KEY}, p90 AS baseline_p90_dbus, usage_days FROM baseline", "baseline_p90_dbus"),
    "cost_by_sku": rounded(
        f"""SELECT {KEY}, sku_category, CAST(c AS DOUBLE) AS total_dbus, ROUND(CAST(c AS DOUBLE) / CAST(j AS DOUBLE) * 100, 1) AS percentage
FROM (SELECT *, SUM(c) OVER (PARTITION BY {KEY}) AS j FROM (
  SELECT {KEY}, {category('sku_name')} AS sku_category, SUM(total_dbus) AS c FROM by_sku GROUP BY ALL) y) x WHERE j > 0""",
        "total_dbus",
    ),
    "team_costs": rounded(
        "SELECT *, total_dbus_30d * 0.5 AS total_cost_dollars FROM team_rows", "total_dbus_30d", "total_cost_dollars"
    ),
    "cost_totals": rounded(
        """SELECT CAST(SUM(total_dbus_30d) AS DOUBLE) AS total_dbus_30d, COUNT(*) AS total_jobs_count,
  CAST(SUM(total_dbus_30d) AS DOUBLE) * 0.5 AS total_cost_dollars FROM by_job""",
        "total_dbus_30d", "total_cost_dollars",
    ),
    "usage_by_job": rounded(
        f"""SELECT {KEY}, sku_name, CAST(SUM(usage_quantity) AS DOUBLE) AS total_dbus, COUNT(DISTINCT usage_date) AS usage_days
FROM spend GROUP BY {KEY}, sku_name HAVING SUM(usage_quantity) <> 0""",
        "total_dbus",
    ),
    "failure_reasons": "SELECT * FROM reasons7",
    "month_usage": rounded(f"SELECT {KEY}, CAST(month_dbus AS DOUBLE) AS month_dbus FROM month_spend", "month_dbus"),
    "run_spans": "SELECT * FROM spans",
    "trend_cost": rounded(COST_SERIES, '"current"', "previous"),
    "trend_cost_weekly": rounded(_cost_series(60, weekly=True), '"current"', "previous"),
    "trend_cost_weekly_long": rounded(_long(_cost_series(60, weekly=True)), '"current"', "previous"),
    "trend_success_weekly_long": rounded(_long(_run_series(60, RATE_OF, WEEK60)), '"current"', "previous"),
    "trend_success": rounded(SUCCESS_SERIES, '"current"', "previous"),
    "trend_success_weekly": rounded(_run_series(60, RATE_OF, WEEK60), '"current"', "previous"),
    "trend_success_team": rounded(_run_series(14, RATE_OF, DAY, team=True), '"current"', "previous"),
    "trend_failures": FAILURE_SERIES,
    "trend_headline": f"""
SELECT ROUND(c, 6) AS current_total, ROUND(p, 6) AS previous_total, change_percent, granularity, series FROM (
SELECT c, p, ROUND(CASE WHEN p > 0 THEN (c - p) / p * 100 ELSE 0.0 END, 1) AS change_percent, 'daily' AS granularity, series FROM (
  SELECT CAST(SUM(CAST("current" AS DECIMAL(18,5))) AS DOUBLE) AS c, CAST(SUM(CAST(previous AS DECIMAL(18,5))) AS DOUBLE) AS p, 'cost' AS series FROM ({COST_SERIES}) s1
  UNION ALL SELECT CAST(SUM("current") AS DOUBLE), CAST(SUM(previous) AS DOUBLE), 'failures' FROM ({FAILURE_SERIES}) s2) x
UNION ALL
SELECT ROUND(AVG("current"), 1), ROUND(AVG(previous), 1), ROUND(AVG("current") - AVG(previous), 1), 'hourly', 'success' FROM ({SUCCESS_SERIES}) s3) y""",
    "health_counts": f"SELECT {HEALTH_COUNTS} FROM health7",
    "health_summary": f"SELECT COUNT(*) AS total_count, {HEALTH_COUNTS}, ROUND({MEAN_RATE}, 1) AS avg_success_rate FROM health7",
    "alert_counts": """
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE severity = 'P1') AS p1_count, COUNT(*) FILTER (WHERE severity = 'P2') AS p2_count,
  COUNT(*) FILTER (WHERE severity = 'P3') AS p3_count FROM feed""",
    "unacked_count": "SELECT COUNT(*) FILTER (WHERE NOT acknowledged) AS unacknowledged FROM feed",
    "highest_severity": f"SELECT {KEY}, MIN(severity) AS highest_severity, COUNT(*) AS alert_count FROM feed GROUP BY {KEY}",
    "active_summary": """
SELECT COUNT(*) AS total_active, COUNT(*) FILTER (WHERE state = 'RUNNING') AS running_count,
  COUNT(*) FILTER (WHERE state = 'PENDING') AS pending_count, COUNT(*) FILTER (WHERE state = 'QUEUED') AS queued_count FROM active_runs""",
    "sla_breach_history": f"""
SELECT {KEY}, CAST(period_start_time AS DATE) AS run_date, sla_minutes, COUNT(*) AS measured_runs,
  COUNT(*) FILTER (WHERE s > sla_minutes * 60) AS breach_count, BOOL_OR(s > sla_minutes * 60) AS breached
FROM effective JOIN tags USING ({KEY}) WHERE sla_minutes IS NOT NULL GROUP BY ALL""",
    "row_count_delta": rounded(
        """SELECT table_name, snapshot_date, current_row_count, baseline_row_count, ROUND(delta, 2) AS delta_percent,
  ROUND(ABS(delta), 9) > 20 AS is_anomaly, trend FROM deltas""",
        "baseline_row_count",
    ),
    "dashboard": f"""
SELECT h.*, a.*, ROUND(c.total_cost, 6) AS total_cost, r.recent_alerts
FROM (SELECT COUNT(*) AS total_jobs, COUNT(*) FILTER (WHERE priority = 'P1') AS critical_jobs, ROUND({MEAN_RATE}, 1) AS avg_success_rate FROM health7) h,
  (SELECT COUNT(*) AS total_alerts, COUNT(*) FILTER (WHERE severity = 'P1') AS critical_alerts FROM feed) a,
  (SELECT CAST(SUM(total_dbus_30d) AS DOUBLE) AS total_cost FROM by_job) c,
  (SELECT STRING_AGG(condition_key, ',' ORDER BY condition_key) AS recent_alerts
    FROM (SELECT condition_key FROM feed ORDER BY severity, condition_key LIMIT 5) x) r""",
    "latest_jobs": f"SELECT {KEY}, name, creator_user_name, change_time FROM latest",
    "consecutive_failures": LAST_STATES.format(window=f" AND {WEEK}"),
    "recent_runs_30d": _long(f"""
SELECT * FROM (SELECT {KEY}, run_id, period_start_time,
  CAST(ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY period_start_time DESC, run_id DESC) AS INTEGER) AS rn
  FROM runs WHERE result_state IS NOT NULL AND {MONTH}) x WHERE rn <= 3"""),
    "recent_runs": f"""
SELECT * FROM (SELECT {KEY}, run_id, period_start_time, result_state,
  CAST(ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY period_start_time DESC, run_id DESC) AS INTEGER) AS rn FROM runs WHERE result_state IS NOT NULL) x
WHERE rn <= 10""",
    "health_ordered": f"SELECT {KEY}, priority, success_rate, {PRIORITY_RANK.format(c='priority')} AS rank FROM health7",
    "alerts_ordered": f"SELECT condition_key, severity, {PRIORITY_RANK.format(c='severity')} AS rank FROM feed",
    "sort_jobs": f"""
SELECT {KEY}, {NAMED}, sla_minutes, COALESCE(sla_minutes, 0) AS sort_key FROM health7 LEFT JOIN tags t USING ({KEY})""",
    "sort_alerts": "SELECT condition_key, title, LOWER(title) AS sort_key FROM feed",
    "sort_costs": f"SELECT {KEY}, team, COALESCE(LOWER(team), 'zzz') AS sort_key FROM costs",
    "sort_teams": "SELECT team, job_count, job_count AS sort_key FROM team_rows",
    "sort_active": f"""
SELECT {KEY}, run_id, state, CASE state WHEN 'RUNNING' THEN 3 WHEN 'TERMINATING' THEN 1 ELSE 2 END AS sort_key FROM active_runs""",
    "top_cost_jobs": rounded(
        f"SELECT {KEY}, job_name, total_dbus_30d FROM costs ORDER BY total_dbus_30d DESC, workspace_id, job_id LIMIT 100",
        "total_dbus_30d",
    ),
    "page_jobs": f"""
SELECT {KEY}, priority, success_rate FROM health7 ORDER BY {PRIORITY_RANK.format(c='priority')}, success_rate, workspace_id, job_id
LIMIT 50 OFFSET 50""",
    "page_jobs_after": f"""
SELECT {KEY}, priority, success_rate FROM health7 WHERE ({PRIORITY_RANK.format(c='priority')}, success_rate, workspace_id, job_id) > (3, 80.0, 1000, 0)
ORDER BY {PRIORITY_RANK.format(c='priority')}, success_rate, workspace_id, job_id LIMIT 50""",
    "page_alerts": "SELECT condition_key, severity FROM feed ORDER BY severity, condition_key LIMIT 50",
    "page_info": 'SELECT COUNT(*) AS total, 2 AS "page", 50 AS page_size, COUNT(*) > 100 AS has_more FROM health7',
    "all_alerts": "SELECT * FROM all_alerts",
    "dedupe_alerts": "SELECT * FROM deduped",
    "schema_drift": f"""
SELECT table_name, BOOL_OR({BOTH} AND (fresh OR gone OR ({RETYPED}))) AS has_drift,
  COALESCE({PAIR_LIST.format(c=f'fresh AND {BOTH}')}, '') AS added_columns,
  COALESCE({PAIR_LIST.format(c='gone')}, '') AS removed_columns,
  COALESCE(STRING_AGG(column_name || ':' || old_type || ':' || new_type, ';' ORDER BY column_name) FILTER (WHERE {RETYPED}), '') AS type_changes
FROM column_pairs GROUP BY table_name""",
    "parse_sku_breakdown": rounded(
        f"SELECT {KEY}, sku_name, CAST(total_dbus AS DOUBLE) AS dbus, {category('sku_name')} AS sku_category FROM by_sku", "dbus"
    ),
    "failure_remediation": f"SELECT {KEY}, failure_reasons, {reason_advice('failure_reasons')} AS remediation FROM reasons30",
    "remediation": f"""
SELECT {KEY}, run_id, {sla_advice('pct', '300')} AS sla, {spike_advice('ROUND(pct / 10, 2)', '2.5')} AS spike,
  {budget_advice('pct')} AS budget, {cluster_advice('ROUND(pct, 2)', '5')} AS cluster
FROM (SELECT {KEY}, run_id, CAST(date_sub('second', start_time, TIMESTAMP '2024-01-31 00:00:00') AS DOUBLE) * 100.0 / 18000 AS pct
  FROM active_runs) x""",
    "dbu_utilization": f"""
SELECT {KEY}, {load_percent('r')} AS worker_percent, {load_percent('r', ' * 0.85')} AS driver_percent
FROM (SELECT {KEY}, ROUND(avg_dbus_per_hour, 6) AS r FROM run_rates) x""",
    "formatted_report": f"""
SELECT {KEY}, {USAGE_TEXT} AS "usage", {COST_TEXT} AS "cost",
  CASE WHEN trend_7d_percent > 0 THEN '+' ELSE '' END || {fixed('trend_7d_percent', 0)} || '%' AS trend,
  CASE WHEN trend_7d_percent >= 0 THEN '+' ELSE '' END || {fixed('trend_7d_percent', 1)} || '%' AS delta,
  {_span_text('median_duration_seconds')} AS median_duration,
  CASE WHEN COALESCE(median_duration_seconds, 0) <= 0 THEN 'no baseline'
    ELSE {fixed('max_duration_seconds / median_duration_seconds', 1)} || 'x baseline' END AS slowest
FROM (SELECT *, total_dbus_30d * 0.5 AS cash FROM costs LEFT JOIN stats_raw USING ({KEY})) x""",
    "formatted_row_counts": f"""
SELECT table_name, {_count_text('(current_row_count * 1500)')} AS "rows",
  CASE WHEN ROUND(delta, 2) >= 0 THEN '+' ELSE '' END || {fixed('ROUND(delta, 2)', 1)} || '%' AS delta FROM deltas""",
    "job_health": _health_list(7),
    "job_health_30d": _health_list(30),
    "job_details": rounded(
        f"""SELECT {KEY}, {NAMED}, recent_runs, {', '.join(DURATIONS)}, COALESCE(run_count, 0) AS run_count,
  COALESCE(has_sufficient_data, FALSE) AS has_sufficient_data, CAST(COALESCE(retry_count, 0) AS BIGINT) AS retry_count_7d,
  COALESCE(failure_reasons, '') AS failure_reasons
FROM ({DETAIL_RUNS}) d LEFT JOIN stats_effective USING ({KEY}) LEFT JOIN retries7 USING ({KEY}) LEFT JOIN reasons30 USING ({KEY})
LEFT JOIN tags t USING ({KEY})""",
        *DURATIONS,
    ),
    "job_costs": rounded(
        "SELECT * FROM costs",
        "total_dbus_30d", "current_7d_dbus", "prev_7d_dbus", "baseline_p90_dbus", "total_cost_dollars",
    ),
    "job_costs_7d": rounded(_long(_job_costs(7)), "total_dbus_30d", "current_7d_dbus", "prev_7d_dbus", "baseline_p90_dbus", "total_cost_dollars"),
    "job_costs_90d": rounded(_long(_job_costs(90)), "total_dbus_30d", "current_7d_dbus", "prev_7d_dbus", "baseline_p90_dbus", "total_cost_dollars"),
    "failure_alerts": "SELECT * FROM failure_alerts",
    "sla_alerts": "SELECT * FROM sla_alerts",
    "overprovision_alerts": "SELECT * FROM cluster_alerts",
    "cluster_utilization": f"""
SELECT {KEY}, d AS driver_cpu_percent, d AS driver_memory_percent, w AS worker_cpu_percent, w AS worker_memory_percent,
  over AS is_over_provisioned, CASE WHEN NOT over THEN NULL WHEN (d + w) / 2 < 20 THEN 'Consider reducing workers by 50% or using smaller node types'
    WHEN (d + w) / 2 < 30 THEN 'Consider reducing to fewer workers' ELSE 'Consider using smaller node types' END AS recommendation, runs_analyzed
FROM cluster_rows""",
    "alerts": "SELECT * FROM feed",
    "report_daily": f"""
SELECT h.*, a.* FROM (SELECT COUNT(*) AS total_jobs, COUNT(*) FILTER (WHERE status = 'green') AS healthy_count,
    COUNT(*) FILTER (WHERE status = 'yellow') AS warning_count, COUNT(*) FILTER (WHERE status = 'red') AS critical_count,
    ROUND({MEAN_RATE}, 1) AS overall_success_rate FROM health7) h,
  (SELECT COUNT(*) FILTER (WHERE severity = 'P1' AND NOT acknowledged) AS open_p1_alerts,
    COUNT(*) FILTER (WHERE severity = 'P2' AND NOT acknowledged) AS open_p2_alerts FROM feed) a""",
    "report_daily_alerts": """
SELECT severity, job_name, title, remediation, condition_key FROM feed WHERE NOT acknowledged AND severity <> 'P3'""",
    "report_weekly": rounded(
        f"""SELECT CASE anomaly_type WHEN 'zombie' THEN 'zombie' ELSE 'spike' END AS section, {KEY}, job_name, current_dbus AS dbus, multiplier AS factor
FROM anomalies UNION ALL SELECT 'top', {KEY}, job_name, total_dbus_30d, NULL
FROM (SELECT * FROM costs ORDER BY total_dbus_30d DESC, workspace_id, job_id LIMIT 10) c""",
        "dbus", "factor",
    ),
    "report_weekly_teams": rounded(TEAM_ROWS, "total_dbus_30d"),
    "report_monthly": f"""
SELECT CAST(total_runs AS BIGINT) AS total_runs, total_jobs, reliability_percent, ROUND(d, 6) AS total_dbus, ROUND(d * 0.05, 2) AS potential_savings,
  ROUND(d * 0.025, 0) AS right_sizing_savings, ROUND(d * 0.015, 0) AS zombie_savings
FROM (SELECT SUM(total_runs) AS total_runs, COUNT(*) AS total_jobs, ROUND({MEAN_RATE}, 2) AS reliability_percent FROM health30) h,
  (SELECT CAST(SUM(total_dbus_30d) AS DOUBLE) AS d FROM by_job) c""",
    "report_monthly_teams": rounded(
        f"SELECT * FROM ({TEAM_ROWS}) r ORDER BY total_dbus_30d DESC, team LIMIT 5", "total_dbus_30d"
    ),
    "duration_windows": rounded(
        "\nUNION ALL ".join(
            f"""SELECT {KEY}, {days} AS window_days, COUNT(*) AS run_count, AVG(s) AS avg_duration_seconds, CAST(MAX(s) AS DOUBLE) AS max_duration_seconds,
  TRUE AS median_within_bound, TRUE AS p90_within_bound
FROM (SELECT *, {EFFECTIVE} AS s FROM runs WHERE result_state IS NOT NULL AND period_end_time IS NOT NULL) x
WHERE s > 0 AND period_start_time >= DATE '2024-01-31' - {days} AND period_start_time < DATE '2024-02-01' GROUP BY ALL"""
            for days in (7, 30, 90)
        ),
        "avg_duration_seconds",
        "max_duration_seconds",
    ),
    "run_dbu_rate_sketched": rounded("SELECT *, TRUE AS within_bound FROM run_rates", "avg_dbus_per_hour"),
    "run_names_then": """
SELECT r.workspace_id, r.job_id, r.run_id, r.period_start_time,
  COALESCE(CASE WHEN v.delete_time IS NULL OR v.delete_time > r.period_start_time THEN v.name END, 'job-' || CAST(r.job_id AS VARCHAR)) AS job_name
FROM runs r ASOF LEFT JOIN jobs v ON r.workspace_id = v.workspace_id AND r.job_id = v.job_id AND r.period_start_time >= v.change_time""",
    "ack_history": f"""
SELECT a.condition_key, a.raised_at, CASE WHEN k.acknowledged_at >= a.raised_at - INTERVAL '24' HOUR THEN k.acknowledged_at END AS acknowledged_at,
  COALESCE(k.acknowledged_at >= a.raised_at - INTERVAL '24' HOUR, FALSE) AS acknowledged
FROM (SELECT DISTINCT {key_text('failure', "'single'")} AS condition_key, period_start_time AS raised_at FROM runs WHERE {FAILED}) a
ASOF LEFT JOIN (SELECT DISTINCT condition_key, acknowledged_at FROM ack_history) k ON a.condition_key = k.condition_key AND a.raised_at >= k.acknowledged_at""",
    "schema_history": """
SELECT table_name, snapshot_version, COALESCE(BOOL_OR(kind IS NOT NULL), FALSE) AS has_drift,
  COALESCE(STRING_AGG(column_name, ',' ORDER BY column_name) FILTER (WHERE kind = 'added'), '') AS added_columns,
  COALESCE(STRING_AGG(column_name, ',' ORDER BY column_name) FILTER (WHERE kind = 'removed'), '') AS removed_columns,
  COALESCE(STRING_AGG(column_name || ':' || old_type || ':' || new_type, ';' ORDER BY column_name) FILTER (WHERE kind = 'retyped'), '') AS type_changes
FROM (SELECT v.table_name, v.snapshot_version, c.column_name, o.data_type AS old_type, n.data_type AS new_type,
    CASE WHEN v.previous IS NULL THEN NULL WHEN o.data_type IS NULL AND n.data_type IS NOT NULL THEN 'added'
      WHEN o.data_type IS NOT NULL AND n.data_type IS NULL THEN 'removed' WHEN o.data_type <> n.data_type THEN 'retyped' END AS kind
  FROM (SELECT table_name, snapshot_version, LAG(snapshot_version) OVER (PARTITION BY table_name ORDER BY snapshot_version) AS previous
    FROM (SELECT DISTINCT table_name, snapshot_version FROM column_history) d) v
  JOIN (SELECT DISTINCT table_name, column_name FROM column_history) c ON c.table_name = v.table_name
  LEFT JOIN column_history n ON n.table_name = v.table_name AND n.snapshot_version = v.snapshot_version AND n.column_name = c.column_name
  LEFT JOIN column_history o ON o.table_name = v.table_name AND o.snapshot_version = v.previous AND o.column_name = c.column_name) x
GROUP BY ALL""",
    "row_count_history": rounded(
        """SELECT table_name, snapshot_date, row_count, baseline_row_count, ROUND(delta, 2) AS delta_percent, ROUND(ABS(delta), 9) > 20 AS is_anomaly
FROM (SELECT *, CASE WHEN baseline_row_count > 0 THEN (row_count - baseline_row_count) / baseline_row_count * 100
    WHEN row_count = 0 THEN 0.0 ELSE 100.0 END AS delta
  FROM (SELECT table_name, snapshot_date, row_count, COALESCE(AVG(row_count) OVER (PARTITION BY table_name ORDER BY snapshot_date
      ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), CAST(row_count AS DOUBLE)) AS baseline_row_count FROM table_snapshots) w) x""",
        "baseline_row_count",
    ),
    "team_and_total_costs": rounded(
        """SELECT *, total_dbus_30d * 0.5 AS total_cost_dollars FROM (
SELECT team, GROUPING(team) = 1 AS is_total, CAST(SUM(total) AS DOUBLE) AS total_dbus_30d, CAST(SUM(job_count) AS BIGINT) AS job_count,
  ROUND(CASE WHEN SUM(base) > 0 THEN CAST(SUM(weighted) AS DOUBLE) / CAST(SUM(base) AS DOUBLE) ELSE 0.0 END, 1) AS trend_7d_percent
FROM teams GROUP BY ROLLUP (team)) x""",
        "total_dbus_30d",
        "total_cost_dollars",
    ),
    "stream_run_counts": f"""
SELECT CAST(DATE_TRUNC('hour', period_start_time) AS TIMESTAMP) AS period, CASE WHEN result_state IS NULL THEN 'open' WHEN {SUCCESS} THEN 'success'
  WHEN {FAILED} THEN 'failed' ELSE 'other' END AS outcome, COUNT(*) AS runs
FROM runs WHERE DATE_TRUNC('hour', period_start_time) + INTERVAL '1' HOUR <=
  (SELECT DATE_TRUNC('milliseconds', MAX(period_start_time)) - INTERVAL '15' MINUTE FROM runs) GROUP BY 1, 2""",
    "stream_consecutive_failures": LAST_STATES.format(window=""),
    "stream_refresh_rollup": _health_list(7),
    "stream_alert_dedupe": f"""
SELECT condition_key, raised_at FROM (WITH RECURSIVE failed AS (
    SELECT DISTINCT 'failure_' || CAST(workspace_id AS VARCHAR) || '_' || CAST(job_id AS VARCHAR) || '_single' AS condition_key,
      period_start_time AS raised_at FROM runs WHERE {FAILED}),
  passed AS (SELECT condition_key, MIN(raised_at) AS raised_at FROM failed GROUP BY 1
    UNION ALL SELECT p.condition_key, MIN(f.raised_at) FROM passed p JOIN failed f
      ON f.condition_key = p.condition_key AND f.raised_at >= p.raised_at + INTERVAL '24' HOUR GROUP BY 1)
  SELECT * FROM passed) x""",
}


def oracle_sql() -> dict[str, str]:
    return {name: assemble(body).strip() for name, body in BODIES.items()}
