"""Table scans (Parquet), R-compatible CSV reader profiles, sinks and stage tables."""
