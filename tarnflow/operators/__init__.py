"""The registered queries by family; importing this package fills the registry."""

from tarnflow.operators import aggregates, events, filters, functions, joins, metadata, partitioned, scans, sets, sorts, subqueries, tpch, windows, writes

__all__ = ["aggregates", "events", "filters", "functions", "joins", "metadata", "partitioned", "scans", "sets", "sorts", "subqueries", "tpch", "windows", "writes"]
