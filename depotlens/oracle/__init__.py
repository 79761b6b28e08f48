"""DuckDB oracle SQL: the canonical tables as CTEs plus one SQL text per
registered query.  Used only for verification, never by the Spark plans."""
