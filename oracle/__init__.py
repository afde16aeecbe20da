"""Plain SQL restatements of the registered queries, for DuckDB."""
