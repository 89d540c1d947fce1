"""Sources and sinks: file listing, CSV and xlsx scans, landing, result sink."""
