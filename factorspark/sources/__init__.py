"""Sources and sinks: bars, index membership, symbol aliases, configuration, files."""
