"""Versioned change logs as DataFrames: point-in-time state, revision analytics,
compaction, verification, block deduplication and change capture."""
