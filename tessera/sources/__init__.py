"""Sources and sinks: driver tables, corpus contracts, index sinks."""
