"""Trip, telemetry and answer-quality analytics as Spark jobs."""
