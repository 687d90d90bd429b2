"""Query plans over the test tables, and session helpers."""
