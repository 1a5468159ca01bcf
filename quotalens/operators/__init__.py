"""DataFrame operators of the audit: DataFrames in, lazy DataFrames out."""
