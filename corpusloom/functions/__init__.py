"""Column functions over texts, scripts and vectors."""
