"""Sources: table scans (S1), declared schemas (S2), literal seeds (S6), JSON I/O."""
