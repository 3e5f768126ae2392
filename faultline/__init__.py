"""Faultline: test-failure triage as Spark jobs."""
