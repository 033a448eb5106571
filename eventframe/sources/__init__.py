"""Sources and sinks: parquet event files, the fixture event view, and JSON/parquet artefacts."""
