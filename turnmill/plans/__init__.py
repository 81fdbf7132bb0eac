"""Named queries: each an operator applied to the driver's tables, with its DuckDB counterpart."""
