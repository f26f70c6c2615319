"""Sources and sinks: vectors, text and CSV files."""
