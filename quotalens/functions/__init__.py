"""Column expressions without state or shuffles."""
