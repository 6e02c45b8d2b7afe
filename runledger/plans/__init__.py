"""Composite results: health table, cost anomalies, alert feed, reports, rollup tables."""
