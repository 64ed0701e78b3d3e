"""Table schemas, readers, sinks and change feeds."""
