"""Readers, landing tables and the views over the test tables."""
