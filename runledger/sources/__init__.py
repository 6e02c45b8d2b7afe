"""Typed readers, rollup tables and the adapter for the sample tables."""
