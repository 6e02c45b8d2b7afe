"""Analytics over job runs, job versions, usage records and table lineage."""
