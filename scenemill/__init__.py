"""Highlight analytics over episodic media metadata, as composable Spark transforms."""
