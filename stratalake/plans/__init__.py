"""Stand-in inputs, registered queries and their DuckDB counterparts."""
