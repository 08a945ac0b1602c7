"""Sources and sinks (S1-S11) and the test-table loaders."""
