"""Sources (text log scans, derived log lines) and sinks."""
