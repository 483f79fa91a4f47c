"""Spark jobs for typing-session telemetry: extraction, quality, cleaning, training, scoring, streaming."""
