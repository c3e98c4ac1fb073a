"""Structured Streaming forms of the intake, the hotspot windows and health."""
