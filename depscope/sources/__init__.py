"""Readers and writers of tables, dependencies, violation lists, metric logs and results."""
