"""Sources and sinks: paged extraction, staging, raw payload store, CSV, dumps, run log."""
