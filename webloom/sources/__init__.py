"""Sources and sinks: fetch logs, a paged file source, table sinks, providers."""
