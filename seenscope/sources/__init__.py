"""Sources and sinks: item tables, trajectory tables, metrics."""
