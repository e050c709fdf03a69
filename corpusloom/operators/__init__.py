"""DataFrame operators: filtering, curation, auditing, labels, metrics, metering, models."""
