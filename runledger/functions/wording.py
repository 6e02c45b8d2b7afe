"""Remediation texts of alerts. The sentences are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import fixed_text, whole_text

# What to do about a failing job, by keyword in its termination codes.
NO_REASON = (
    "Review recent run logs for error details. Check for resource constraints or data quality issues."
)
REASON_ADVICE = [
    (
        ["memory", "oom", "heap"],
        "Memory issue detected. Consider increasing cluster size, enabling autoscaling, "
        "or optimizing data processing (partitioning, caching).",
    ),
    (
        ["timeout", "timed out"],
        "Timeout detected. Review job duration trends, consider increasing timeout limits, "
        "or optimize slow operations.",
    ),
    (
        ["null", "schema", "type"],
        "Data quality issue detected. Validate input data schemas, add null handling, "
        "and implement data quality checks.",
    ),
    (
        ["permission", "access", "denied"],
        "Permission issue detected. Review service principal permissions and IAM roles.",
    ),
]
OTHER_REASONS = "Recent failures: {codes}. Review run logs and check for infrastructure or data issues."

# Advice on usage.
BUDGET_EXCEEDED = (
    "Monthly budget exceeded. Review recent job runs for unexpected usage. "
    "Consider cost allocation review with team."
)
BUDGET_APPROACHING = (
    "Approaching monthly budget limit. Monitor usage closely and consider adjusting "
    "job frequency or resource allocation."
)
COST_UNKNOWN = "Cost anomaly detected. Review job resource usage and recent changes."


def fill(template: str, **values: Column) -> Column:
    """``"a {x} b"`` with columns for the names; NULL if any value is NULL."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        if head:
            parts.append(F.lit(head))
        parts.append(values[name])
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def failure_remediation(codes: Column) -> Column:
    """Advice for an array of termination codes; the first matching topic wins."""
    text = fill(OTHER_REASONS, codes=F.array_join(F.slice(codes, 1, 3), ", "))
    joined = F.lower(F.array_join(codes, "\n"))
    for words, advice in reversed(REASON_ADVICE):
        text = F.when(joined.rlike("|".join(words)), advice).otherwise(text)
    return F.when(codes.isNull() | (F.size(codes) == 0), NO_REASON).otherwise(text)


def sla_remediation(elapsed_pct: Column, sla_minutes: Column) -> Column:
    target = sla_minutes.cast("string")
    breached = fill(
        "SLA breached. Job exceeded {target} minute target. Review job history for duration trends "
        "and consider SLA adjustment or performance optimization.",
        target=target,
    )
    risk = fill(
        "~{left} minutes remaining before SLA breach ({target} min target). "
        "Monitor actively or prepare fallback.",
        left=whole_text(sla_minutes * (F.lit(100) - elapsed_pct) / 100),
        target=target,
    )
    return F.when(elapsed_pct >= 100, breached).otherwise(risk)


def spike_remediation(multiplier: Column, baseline: Column) -> Column:
    text = fill(
        "Cost is {x}x higher than p90 baseline ({base} DBUs). Check for increased data volume, "
        "cluster misconfiguration, or inefficient operations.",
        x=fixed_text(multiplier, 1),
        base=fixed_text(baseline, 1),
    )
    known = (F.coalesce(multiplier, F.lit(0.0)) != 0) & (F.coalesce(baseline, F.lit(0.0)) != 0)
    return F.when(known, text).otherwise(COST_UNKNOWN)


def budget_remediation(used_pct: Column) -> Column:
    return F.when(used_pct >= 100, BUDGET_EXCEEDED).otherwise(BUDGET_APPROACHING)


def cluster_remediation(utilization: Column, runs_analyzed: Column) -> Column:
    reduction = (
        F.when(utilization < 20, "50%").when(utilization < 30, "30-40%").otherwise("20-30%")
    )
    return fill(
        "Cluster running at ~{pct}% utilization across {runs} recent runs. "
        "Consider reducing workers by {cut} or using smaller node types.",
        pct=fixed_text(utilization, 0),
        runs=runs_analyzed.cast("string"),
        cut=reduction,
    )
