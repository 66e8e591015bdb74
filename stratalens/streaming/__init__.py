"""Structured Streaming forms of the telemetry summaries."""
