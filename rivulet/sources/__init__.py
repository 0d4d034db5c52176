"""Sources, sinks and the log-record model."""
