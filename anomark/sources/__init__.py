"""Sources and sinks: test tables, N-Triples text (batch and stream), metadata snapshots."""
