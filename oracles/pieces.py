"""Common table expressions and text helpers the SQL checks are assembled from."""

from __future__ import annotations

import re

from runledger.sources.sample import VIEWS

KEY = "workspace_id, job_id"
FAILED = "UPPER(result_state) IN ('FAILED', 'FAILURE')"
SUCCESS = "UPPER(result_state) IN ('SUCCESS', 'SUCCEEDED')"
WEEK = "period_start_time >= DATE '2024-01-24' AND period_start_time < DATE '2024-02-01'"
MONTH = "period_start_time >= DATE '2024-01-01' AND period_start_time < DATE '2024-02-01'"
EFFECTIVE = (
    "CASE WHEN run_duration_seconds IS NULL OR run_duration_seconds = 0 "
    "THEN date_sub('second', period_start_time, period_end_time) ELSE run_duration_seconds END"
)
RATE = "ROUND(100.0 * CAST(COUNT(*) FILTER (WHERE {s}) AS DOUBLE) / COUNT(*), 1)".format(s=SUCCESS)


def fixed(expr: str, places: int) -> str:
    return f"CAST(CAST(ROUND(CAST({expr} AS DOUBLE), {places}) AS DECIMAL(28,{places})) AS VARCHAR)"


def whole(expr: str) -> str:
    return f"CAST(CAST(FLOOR({expr}) AS BIGINT) AS VARCHAR)"


def text(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


def key_text(prefix: str, suffix: str) -> str:
    return f"'{prefix}_' || CAST(workspace_id AS VARCHAR) || '_' || CAST(job_id AS VARCHAR) || '_' || {suffix}"


def category(sku: str) -> str:
    return (
        f"CASE WHEN UPPER({sku}) LIKE '%ALL\\_PURPOSE%' ESCAPE '\\' THEN 'All-Purpose' "
        f"WHEN UPPER({sku}) LIKE '%JOBS%' THEN 'Jobs Compute' WHEN UPPER({sku}) LIKE '%SQL%' THEN 'SQL Warehouse' "
        f"WHEN UPPER({sku}) LIKE '%SERVERLESS%' THEN 'Serverless' ELSE 'Other' END"
    )


def trend(cur: str, prev: str) -> str:
    c, p = f"CAST({cur} AS DOUBLE)", f"CAST({prev} AS DOUBLE)"
    return f"ROUND(CASE WHEN {p} > 0 THEN ({c} - {p}) / {p} * 100 WHEN {c} > 0 THEN 100.0 ELSE 0.0 END, 1)"


def load_percent(rate: str, factor: str = "") -> str:
    steps = (
        f"CASE WHEN {rate} < 1 THEN 20.0 WHEN {rate} < 2 THEN 40.0 WHEN {rate} < 4 THEN 60.0 "
        f"ELSE LEAST(80.0 + ({rate} - 4) * 2, 95.0) END"
    )
    return f"CASE WHEN {rate} > 0 THEN ROUND(CAST({steps} AS DOUBLE){factor}, 1) END"


def reason_advice(codes: str) -> str:
    """Advice for a comma list of codes held in ``codes``."""
    low = f"LOWER({codes})"

    def any_of(*words: str) -> str:
        return "(" + " OR ".join(f"{low} LIKE '%{w}%'" for w in words) + ")"

    first_three = f"array_to_string(list_slice(string_split({codes}, ','), 1, 3), ', ')"
    return f"""CASE WHEN {codes} IS NULL OR {codes} = ''
  THEN 'Review recent run logs for error details. Check for resource constraints or data quality issues.'
  WHEN {any_of('memory', 'oom', 'heap')}
  THEN 'Memory issue detected. Consider increasing cluster size, enabling autoscaling, or optimizing data processing (partitioning, caching).'
  WHEN {any_of('timeout', 'timed out')}
  THEN 'Timeout detected. Review job duration trends, consider increasing timeout limits, or optimize slow operations.'
  WHEN {any_of('null', 'schema', 'type')}
  THEN 'Data quality issue detected. Validate input data schemas, add null handling, and implement data quality checks.'
  WHEN {any_of('permission', 'access', 'denied')}
  THEN 'Permission issue detected. Review service principal permissions and IAM roles.'
  ELSE 'Recent failures: ' || {first_three} || '. Review run logs and check for infrastructure or data issues.' END"""


def sla_advice(pct: str, minutes: str) -> str:
    return (
        f"CASE WHEN {pct} >= 100 THEN 'SLA breached. Job exceeded ' || {text(minutes)} || ' minute target. "
        f"Review job history for duration trends and consider SLA adjustment or performance optimization.' "
        f"ELSE '~' || {whole(f'{minutes} * (100 - {pct}) / 100')} || ' minutes remaining before SLA breach (' || "
        f"{text(minutes)} || ' min target). Monitor actively or prepare fallback.' END"
    )


def spike_advice(multiplier: str, base: str) -> str:
    return (
        f"CASE WHEN {multiplier} = 0 OR {base} = 0 THEN 'Cost anomaly detected. Review job resource usage and recent changes.' "
        f"ELSE 'Cost is ' || {fixed(multiplier, 1)} || 'x higher than p90 baseline (' || {fixed(base, 1)} || "
        f"' DBUs). Check for increased data volume, cluster misconfiguration, or inefficient operations.' END"
    )


def budget_advice(pct: str) -> str:
    return (
        f"CASE WHEN {pct} >= 100 THEN 'Monthly budget exceeded. Review recent job runs for unexpected usage. "
        f"Consider cost allocation review with team.' ELSE 'Approaching monthly budget limit. Monitor usage closely "
        f"and consider adjusting job frequency or resource allocation.' END"
    )


def cluster_advice(pct: str, runs: str) -> str:
    return (
        f"'Cluster running at ~' || {fixed(pct, 0)} || '% utilization across ' || {text(runs)} || "
        f"' recent runs. Consider reducing workers by ' || CASE WHEN {pct} < 20 THEN '50%' WHEN {pct} < 30 "
        f"THEN '30-40%' ELSE '20-30%' END || ' or using smaller node types.'"
    )


# Windows over the finished runs of a period: newest state by LAG over ascending time.
def states(window: str) -> str:
    return f"""
SELECT {KEY}, period_start_time, run_duration_seconds, result_state,
  LAG(result_state) OVER w AS prev_state, ROW_NUMBER() OVER (PARTITION BY {KEY}
    ORDER BY period_start_time DESC, run_id DESC) AS rn
FROM runs WHERE result_state IS NOT NULL AND {window}
WINDOW w AS (PARTITION BY {KEY} ORDER BY period_start_time, run_id)"""


def health(window: str) -> str:
    """Statistics, newest run and priority of each job with finished runs in the window."""
    prev = FAILED.replace("result_state", "prev_state")
    return f"""
SELECT s.*, l.period_start_time AS last_run_time, l.run_duration_seconds AS last_duration_seconds,
  l.failed AS last_failed,
  l.both_failed,
  CASE WHEN l.both_failed THEN 'P1' WHEN l.failed THEN 'P2' WHEN s.success_rate BETWEEN 70 AND 89.9 THEN 'P3' END AS priority,
  CASE WHEN s.success_rate >= 90 THEN 'green' WHEN s.success_rate >= 70 THEN 'yellow' ELSE 'red' END AS status
FROM (SELECT {KEY}, COUNT(*) AS total_runs, COUNT(*) FILTER (WHERE {SUCCESS}) AS success_count,
    COUNT(*) FILTER (WHERE {FAILED}) AS failed_count, {RATE} AS success_rate
  FROM runs WHERE result_state IS NOT NULL AND {window} GROUP BY ALL) s
JOIN (SELECT *, COALESCE({FAILED}, FALSE) AS failed, COALESCE({FAILED} AND {prev}, FALSE) AS both_failed
  FROM ({states(window)}) q WHERE rn = 1) l USING ({KEY})"""


DEFINITIONS: dict[str, str] = {
    "latest": f"""
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY change_time DESC) AS rn FROM jobs) v
WHERE rn = 1 AND delete_time IS NULL""",
    "tags": f"""
SELECT {KEY}, name, TRY_CAST(sla_minutes AS INTEGER) AS sla_minutes, team, creator_user_name AS owner,
  TRY_CAST(budget_monthly_dbus AS DOUBLE) AS budget_monthly_dbus, output_tables FROM latest""",
    "health7": health(WEEK),
    "health30": health(MONTH),
    "open7": f"SELECT {KEY}, COUNT(*) AS open_runs FROM runs WHERE period_end_time IS NULL AND {WEEK} GROUP BY ALL",
    "open30": f"SELECT {KEY}, COUNT(*) AS open_runs FROM runs WHERE period_end_time IS NULL AND {MONTH} GROUP BY ALL",
    "retries7": f"""
SELECT {KEY}, CAST(SUM(CASE WHEN n > 1 THEN n - 1 ELSE 0 END) AS BIGINT) AS retry_count
FROM (SELECT {KEY}, CAST(period_start_time AS DATE) AS d, COUNT(*) AS n FROM runs
  WHERE result_state IS NOT NULL AND {WEEK} GROUP BY ALL) x GROUP BY ALL""",
    "retries30": f"""
SELECT {KEY}, COUNT(*) - COUNT(DISTINCT CAST(period_start_time AS DATE)) AS retry_count
FROM runs WHERE result_state IS NOT NULL AND {MONTH} GROUP BY ALL""",
    "durations": f"""
SELECT {KEY}, run_id, period_start_time, CAST(run_duration_seconds AS BIGINT) AS s FROM runs
WHERE result_state IS NOT NULL AND run_duration_seconds IS NOT NULL AND {MONTH}""",
    "effective": f"""
SELECT * FROM (SELECT {KEY}, run_id, period_start_time, {EFFECTIVE} AS s FROM runs
  WHERE result_state IS NOT NULL AND period_end_time IS NOT NULL AND {MONTH}) x WHERE s > 0""",
    "stats_raw": f"""
SELECT {KEY}, quantile_cont(CAST(s AS DOUBLE), 0.5) AS median_duration_seconds,
  quantile_cont(CAST(s AS DOUBLE), 0.9) AS p90_duration_seconds, AVG(s) AS avg_duration_seconds,
  CAST(MAX(s) AS DOUBLE) AS max_duration_seconds, COUNT(*) AS run_count, COUNT(*) >= 5 AS has_sufficient_data
FROM durations GROUP BY ALL""",
    "stats_effective": f"""
SELECT {KEY}, quantile_cont(CAST(s AS DOUBLE), 0.5) AS median_duration_seconds,
  quantile_cont(CAST(s AS DOUBLE), 0.9) AS p90_duration_seconds, AVG(s) AS avg_duration_seconds,
  CAST(MAX(s) AS DOUBLE) AS max_duration_seconds, COUNT(*) AS run_count, COUNT(*) >= 5 AS has_sufficient_data
FROM effective GROUP BY ALL""",
    "reasons7": f"""
SELECT {KEY}, STRING_AGG(DISTINCT termination_code, ',' ORDER BY termination_code) AS failure_reasons
FROM runs WHERE {FAILED} AND termination_code IS NOT NULL AND {WEEK} GROUP BY ALL""",
    "reasons30": f"""
SELECT {KEY}, STRING_AGG(DISTINCT termination_code, ',' ORDER BY termination_code) AS failure_reasons
FROM runs WHERE {FAILED} AND termination_code IS NOT NULL AND {MONTH} GROUP BY ALL""",
    "spend": """
SELECT workspace_id, TRY_CAST(job_id AS BIGINT) AS job_id, sku_name, usage_date, usage_quantity FROM usage
WHERE TRY_CAST(job_id AS BIGINT) IS NOT NULL AND usage_date >= DATE '2024-01-01' AND usage_date <= DATE '2024-01-31'""",
    "daily": f"SELECT {KEY}, usage_date, SUM(usage_quantity) AS dbus FROM spend GROUP BY ALL",
    "by_sku": f"""
SELECT {KEY}, sku_name, SUM(usage_quantity) AS total_dbus,
  COALESCE(SUM(usage_quantity) FILTER (WHERE usage_date >= DATE '2024-01-24'), 0) AS current_7d,
  COALESCE(SUM(usage_quantity) FILTER (WHERE usage_date >= DATE '2024-01-17' AND usage_date < DATE '2024-01-24'), 0) AS prev_7d
FROM spend GROUP BY ALL HAVING SUM(usage_quantity) <> 0""",
    "by_job": f"""
SELECT {KEY}, SUM(total_dbus) AS total_dbus_30d, SUM(current_7d) AS current_7d_dbus, SUM(prev_7d) AS prev_7d_dbus,
  STRING_AGG(sku_name || ':' || CAST(CAST(total_dbus AS DECIMAL(28,5)) AS VARCHAR), ',' ORDER BY sku_name) AS sku_breakdown
FROM by_sku GROUP BY ALL""",
    "baseline": f"""
SELECT {KEY}, quantile_cont(CAST(dbus AS DOUBLE), 0.9) AS p90, COUNT(*) AS usage_days
FROM daily WHERE dbus <> 0 GROUP BY ALL HAVING COUNT(*) >= 5""",
    "baseline_positive": f"""
SELECT {KEY}, quantile_cont(CAST(dbus AS DOUBLE), 0.9) AS p90
FROM daily WHERE dbus > 0 GROUP BY ALL HAVING COUNT(*) >= 5""",
    "costs": f"""
SELECT {KEY}, COALESCE(t.name, 'job-' || CAST(job_id AS VARCHAR)) AS job_name, t.team,
  CAST(total_dbus_30d AS DOUBLE) AS total_dbus_30d, CAST(current_7d_dbus AS DOUBLE) AS current_7d_dbus,
  CAST(prev_7d_dbus AS DOUBLE) AS prev_7d_dbus, {trend('current_7d_dbus', 'prev_7d_dbus')} AS trend_7d_percent,
  sku_breakdown, p90 AS baseline_p90_dbus,
  COALESCE(current_7d_dbus > 0 AND p90 > 0 AND CAST(current_7d_dbus AS DOUBLE) > 2 * p90, FALSE) AS is_anomaly,
  CAST(total_dbus_30d AS DOUBLE) * 0.5 AS total_cost_dollars
FROM by_job LEFT JOIN tags t USING ({KEY}) LEFT JOIN baseline USING ({KEY})""",
    "teams": """
SELECT COALESCE(team, 'Untagged') AS team, SUM(CAST(total_dbus_30d AS DECIMAL(28,5))) AS total, COUNT(*) AS job_count,
  SUM(CASE WHEN trend_7d_percent <> 0 THEN CAST(total_dbus_30d AS DECIMAL(18,5)) * CAST(trend_7d_percent AS DECIMAL(9,1)) ELSE 0 END) AS weighted,
  SUM(CASE WHEN trend_7d_percent <> 0 THEN CAST(total_dbus_30d AS DECIMAL(18,5)) ELSE 0 END) AS base
FROM costs GROUP BY 1""",
    "team_rows": """
SELECT team, CAST(total AS DOUBLE) AS total_dbus_30d, job_count,
  ROUND(CASE WHEN base > 0 THEN CAST(weighted AS DOUBLE) / CAST(base AS DOUBLE) ELSE 0.0 END, 1) AS trend_7d_percent
FROM teams""",
    "week_spend": f"""
SELECT {KEY}, SUM(dbus) AS week FROM daily WHERE usage_date >= DATE '2024-01-24' GROUP BY ALL HAVING SUM(dbus) > 0""",
    "spikes": f"""
SELECT {KEY}, CAST(week AS DOUBLE) AS current_dbus, p90 AS baseline_p90_dbus, CAST(week AS DOUBLE) / p90 AS multiplier
FROM week_spend JOIN baseline_positive USING ({KEY}) WHERE CAST(week AS DOUBLE) > 2 * p90""",
    "zombies": f"""
SELECT {KEY}, CAST(c.total AS DOUBLE) AS total_dbus, COALESCE(o.total_runs, 0) AS run_count,
  COALESCE(o.success_count, 0) AS success_count
FROM (SELECT {KEY}, SUM(dbus) AS total FROM daily GROUP BY ALL HAVING SUM(dbus) > 10) c
LEFT JOIN health30 o USING ({KEY})
WHERE COALESCE(o.success_count, 0) = 0 OR CAST(c.total AS DOUBLE) / NULLIF(o.total_runs, 0) > 5""",
    "anomalies": f"""
SELECT {KEY}, job_name, team, 'cost_spike' AS anomaly_type,
  'Cost ' || {fixed('current_7d_dbus / baseline_p90_dbus', 1)} || 'x higher than p90 baseline' AS reason,
  current_7d_dbus AS current_dbus, baseline_p90_dbus, current_7d_dbus / baseline_p90_dbus AS multiplier
FROM costs WHERE is_anomaly AND baseline_p90_dbus > 0
UNION ALL
SELECT {KEY}, COALESCE(t.name, 'job-' || CAST(job_id AS VARCHAR)), t.team, 'zombie',
  CASE WHEN success_count = 0 AND run_count > 0 THEN 'High cost (' || {fixed('total_dbus', 1)} ||
      ' DBUs) with 0 successful runs out of ' || CAST(run_count AS VARCHAR) || ' attempts'
    WHEN run_count = 0 THEN 'High cost (' || {fixed('total_dbus', 1)} || ' DBUs) with no detected runs'
    ELSE 'High cost per run (' || {fixed('total_dbus / NULLIF(run_count, 0)', 1)} || ' DBUs/run) may indicate inefficiency' END,
  total_dbus, NULL, NULL
FROM zombies LEFT JOIN tags t USING ({KEY})
WHERE ({KEY}) NOT IN (SELECT ({KEY}) FROM costs WHERE is_anomaly AND baseline_p90_dbus > 0)""",
    "month_spend": f"""
SELECT {KEY}, SUM(usage_quantity) AS month_dbus FROM spend GROUP BY ALL HAVING SUM(usage_quantity) > 0""",
    "run_rates": f"""
SELECT {KEY}, AVG(COALESCE(CAST(d.dbus AS DOUBLE), 0) / (e.s / 3600.0)) AS avg_dbus_per_hour,
  COUNT(DISTINCT e.run_id) AS runs_analyzed
FROM effective e LEFT JOIN (SELECT * FROM daily WHERE dbus > 0) d
  ON e.workspace_id = d.workspace_id AND e.job_id = d.job_id AND CAST(e.period_start_time AS DATE) = d.usage_date
GROUP BY e.workspace_id, e.job_id HAVING COUNT(DISTINCT e.run_id) >= 3""".replace(
        f"SELECT {KEY}, AVG", "SELECT e.workspace_id, e.job_id, AVG"
    ),
    "last_five": f"""
SELECT e.workspace_id, e.job_id, e.rn, COALESCE(CAST(d.dbus AS DOUBLE), 0) / (e.s / 3600.0) AS rate
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY period_start_time DESC, run_id DESC) AS rn FROM effective) e
LEFT JOIN (SELECT * FROM daily WHERE dbus <> 0) d
  ON e.workspace_id = d.workspace_id AND e.job_id = d.job_id AND CAST(e.period_start_time AS DATE) = d.usage_date
WHERE e.rn <= 5""",
    "cluster": f"""
SELECT {KEY}, COUNT(*) AS runs_analyzed, AVG(rate) FILTER (WHERE rate > 0) AS avg_rate,
  COUNT(*) FILTER (WHERE {load_percent('rate')} < 40) AS low_runs FROM last_five GROUP BY ALL""",
    "cluster_rows": f"""
SELECT *, COALESCE(runs_analyzed >= 5 AND (d + w) / 2 < 40 AND low_runs = runs_analyzed, FALSE) AS over
FROM (SELECT *, {load_percent('avg_rate', ' * 0.85')} AS d, {load_percent('avg_rate')} AS w FROM cluster) x""",
    "failure_alerts": f"""
SELECT {key_text('failure', 'LOWER(severity)')} AS alert_id, {KEY}, job_name, 'failure' AS category, severity,
  CASE severity WHEN 'P1' THEN '2+ consecutive failures' WHEN 'P2' THEN 'Recent failure'
    ELSE 'Success rate at ' || {fixed('success_rate', 1)} || '%' END AS title,
  CASE severity WHEN 'P1' THEN 'Job has failed 2+ times in a row. Most recent failure at ' || last_at || '.'
    WHEN 'P2' THEN 'Job failed at ' || last_at || '. Success rate: ' || {fixed('success_rate', 1)} || '%.'
    ELSE 'Job is in yellow zone (70-89% success rate). May need attention.' END AS description,
  {reason_advice('failure_reasons')} AS remediation,
  {key_text('failure', "CASE severity WHEN 'P1' THEN 'consecutive' WHEN 'P2' THEN 'single' ELSE 'yellow' END")} AS condition_key
FROM (SELECT {KEY}, COALESCE(t.name, 'job-' || CAST(job_id AS VARCHAR)) AS job_name, h.priority AS severity,
    h.success_rate, strftime(h.last_run_time, '%Y-%m-%d %H:%M:%S') AS last_at, r.failure_reasons
  FROM health7 h LEFT JOIN tags t USING ({KEY}) LEFT JOIN reasons7 r USING ({KEY}) WHERE h.priority IS NOT NULL) x""",
    "sla_alerts": f"""
SELECT {key_text('sla', 'LOWER(severity)')} AS alert_id, {KEY}, job_name, 'sla' AS category, severity,
  CASE severity WHEN 'P1' THEN 'SLA breached (' || {text('m')} || 'm target)'
    ELSE 'SLA breach risk (' || {whole('pct')} || '% of window)' END AS title,
  CASE severity WHEN 'P1' THEN 'Job has been running for ' || {whole('el / 60')} || ' minutes, exceeding ' || {text('m')} || ' minute SLA.'
    ELSE 'Job at ' || {whole('pct')} || '% of SLA window (' || {text('m')} || 'm). ~' || {whole('(m * 60 - el) / 60')} || ' minutes remaining.' END AS description,
  {sla_advice('pct', 'm')} AS remediation,
  {key_text('sla', "CASE severity WHEN 'P1' THEN 'breach' ELSE 'risk' END")} AS condition_key
FROM (SELECT *, CASE WHEN pct >= 100 THEN 'P1' ELSE 'P2' END AS severity FROM (
  SELECT a.workspace_id, a.job_id, t.name AS job_name, t.sla_minutes AS m,
    date_sub('second', a.start_time, TIMESTAMP '2024-01-31 00:00:00') AS el,
    CAST(date_sub('second', a.start_time, TIMESTAMP '2024-01-31 00:00:00') AS DOUBLE) * 100.0 / (t.sla_minutes * 60) AS pct
  FROM active_runs a JOIN tags t USING ({KEY}) WHERE t.sla_minutes > 0) y WHERE pct >= 80) x""",
    "spike_alerts": f"""
SELECT {key_text('cost', "'spike'")} AS alert_id, {KEY}, COALESCE(t.name, 'job-' || CAST(job_id AS VARCHAR)) AS job_name,
  'cost' AS category, 'P2' AS severity, 'Cost spike (' || {fixed('multiplier', 1)} || 'x baseline)' AS title,
  'Current 7-day cost (' || {fixed('current_dbus', 1)} || ' DBUs) is ' || {fixed('multiplier', 1)} ||
    'x higher than p90 baseline (' || {fixed('baseline_p90_dbus', 1)} || ' DBUs).' AS description,
  {spike_advice('multiplier', 'baseline_p90_dbus')} AS remediation, {key_text('cost', "'spike'")} AS condition_key
FROM spikes LEFT JOIN tags t USING ({KEY})""",
    "budget_alerts": f"""
SELECT {key_text('cost', "'budget'")} AS alert_id, {KEY}, name AS job_name, 'cost' AS category, severity,
  CASE severity WHEN 'P1' THEN 'Budget exceeded (' ELSE 'Approaching budget (' END || {fixed('pct', 0)} || '%)' AS title,
  'Monthly usage (' || {fixed('used', 1)} || ' DBUs) ' || CASE severity WHEN 'P1' THEN 'exceeds budget ('
    ELSE 'at ' || {fixed('pct', 0)} || '% of budget (' END || {fixed('budget', 1)} || ' DBUs).' AS description,
  {budget_advice('pct')} AS remediation,
  {key_text('cost', "CASE severity WHEN 'P1' THEN 'budget_exceeded' ELSE 'budget_approaching' END")} AS condition_key
FROM (SELECT *, CASE WHEN pct >= 100 THEN 'P1' ELSE 'P2' END AS severity FROM (
  SELECT {KEY}, name, budget_monthly_dbus AS budget, COALESCE(CAST(month_dbus AS DOUBLE), 0) AS used,
    COALESCE(CAST(month_dbus AS DOUBLE), 0) / budget_monthly_dbus * 100 AS pct
  FROM tags LEFT JOIN month_spend USING ({KEY}) WHERE budget_monthly_dbus > 0) y WHERE pct >= 80) x""",
    "cluster_alerts": f"""
SELECT {key_text('cluster', "'overprov'")} AS alert_id, {KEY}, job_name, 'cluster' AS category, 'P3' AS severity,
  'Over-provisioned (~' || {fixed('u', 0)} || '% utilization)' AS title,
  'Cluster running at ~' || {fixed('u', 0)} || '% utilization across ' || {text('runs_analyzed')} ||
    ' recent runs. Resources may be underutilized.' AS description,
  {cluster_advice('u', 'runs_analyzed')} AS remediation, {key_text('cluster', "'overprov'")} AS condition_key
FROM (SELECT {KEY}, COALESCE(t.name, 'job-' || CAST(job_id AS VARCHAR)) AS job_name, runs_analyzed,
    COALESCE({load_percent('avg_dbus_per_hour')}, 20.0) AS u
  FROM run_rates LEFT JOIN tags t USING ({KEY}) WHERE avg_dbus_per_hour < 1.0) x""",
    "all_alerts": """
SELECT * FROM failure_alerts UNION ALL SELECT * FROM sla_alerts UNION ALL SELECT * FROM spike_alerts
UNION ALL SELECT * FROM budget_alerts UNION ALL SELECT * FROM cluster_alerts""",
    "deduped": """
SELECT * EXCLUDE (pick) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY condition_key
  ORDER BY severity, alert_id, workspace_id, job_id, job_name, category, title, description, remediation) AS pick
  FROM all_alerts) x WHERE pick = 1""",
    "valid_acks": """
SELECT condition_key, MAX(acknowledged_at) AS acknowledged_at FROM acks
WHERE acknowledged_at >= TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1""",
    "feed": """
SELECT d.*, a.acknowledged_at, a.acknowledged_at IS NOT NULL AS acknowledged, TIMESTAMP '2024-01-31 00:00:00' AS created_at
FROM deduped d LEFT JOIN valid_acks a USING (condition_key)""",
    "lineage_tables": f"""
SELECT DISTINCT {KEY}, target_table_full_name AS table_name FROM lineage
WHERE entity_type = 'JOB' AND target_table_full_name IS NOT NULL
  AND event_time >= DATE '2024-01-01' AND event_time < DATE '2024-02-01'""",
    "output_lists": f"""
SELECT {KEY}, table_name, 'lineage' AS origin FROM lineage_tables
UNION ALL
SELECT {KEY}, table_name, 'tag' FROM (SELECT {KEY}, TRIM(UNNEST(string_split(output_tables, ','))) AS table_name FROM tags
  WHERE output_tables IS NOT NULL) x
WHERE table_name <> '' AND NOT EXISTS (SELECT 1 FROM lineage_tables l
  WHERE l.workspace_id = x.workspace_id AND l.job_id = x.job_id)""",
    "spans": f"""
SELECT {KEY}, run_id, result_state, MIN(period_start_time) AS period_start_time, MAX(period_end_time) AS period_end_time,
  date_sub('second', MIN(period_start_time), MAX(period_end_time)) AS duration_seconds
FROM run_periods WHERE result_state IS NOT NULL AND {MONTH} GROUP BY {KEY}, run_id, result_state""",
    "snapshot_ranks": """
SELECT *, ROW_NUMBER() OVER (PARTITION BY table_name ORDER BY snapshot_date DESC) AS rn FROM table_snapshots""",
    "deltas": """
SELECT table_name, snapshot_date, current_row_count, baseline_row_count,
  CASE WHEN baseline_row_count > 0 THEN (current_row_count - baseline_row_count) / baseline_row_count * 100
    WHEN current_row_count = 0 THEN 0.0 ELSE 100.0 END AS delta, trend
FROM (SELECT table_name, MAX(snapshot_date) FILTER (WHERE rn = 1) AS snapshot_date,
    MAX(row_count) FILTER (WHERE rn = 1) AS current_row_count,
    COALESCE(AVG(row_count) FILTER (WHERE rn BETWEEN 2 AND 11), CAST(MAX(row_count) FILTER (WHERE rn = 1) AS DOUBLE)) AS baseline_row_count,
    STRING_AGG(CAST(snapshot_date AS VARCHAR) || '=' || CAST(row_count AS VARCHAR), ';' ORDER BY rn) FILTER (WHERE rn <= 5) AS trend
  FROM snapshot_ranks GROUP BY 1) x""",
    "column_pairs": """
SELECT COALESCE(n.table_name, o.table_name) AS table_name, COALESCE(n.column_name, o.column_name) AS column_name,
  n.data_type AS new_type, o.data_type AS old_type, n.column_name IS NULL AS gone, o.column_name IS NULL AS fresh
FROM (SELECT * FROM column_snapshots WHERE snapshot_version = 2) n
FULL OUTER JOIN (SELECT * FROM column_snapshots WHERE snapshot_version = 1) o
  ON n.table_name = o.table_name AND n.column_name = o.column_name""",
}


def _used(body: str, names: list[str]) -> list[str]:
    return [n for n in names if re.search(rf"(FROM|JOIN)\s+{n}\b", body)]


def assemble(body: str) -> str:
    """The query behind every view and definition it reads, in dependency order."""
    sources = {**VIEWS, **DEFINITIONS}
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in _used(sql, list(sources)):
            if name not in order:
                visit(sources[name])
                order.append(name)

    visit(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({sources[n]})" for n in order) + "\n" + body


def rounded(body: str, *columns: str) -> str:
    """``body`` with the named DOUBLE columns rounded to six places."""
    replaced = ", ".join(f"ROUND({c}, 6) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({replaced}) FROM ({body}) rounded_rows"
