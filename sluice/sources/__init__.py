"""Sources and sinks: test-table views, stream reads/writes, audit files."""
