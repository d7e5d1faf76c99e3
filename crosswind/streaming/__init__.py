"""Incremental forms of three batch behaviours, as Structured Streaming jobs."""
