"""Query catalogue: one entry per operator, each with DuckDB SQL where SQL can express it."""
