"""Column functions: time codes, text, JSON and scores."""
