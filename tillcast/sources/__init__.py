"""Readers and writers: CSV files, log files, keyed tables and the test tables."""
