"""Agent-session analytics as Spark jobs: transcripts in, telemetry relations and reports out."""
