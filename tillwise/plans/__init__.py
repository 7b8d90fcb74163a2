"""Named analyses over the test tables (registry) and their DuckDB oracle SQL."""
