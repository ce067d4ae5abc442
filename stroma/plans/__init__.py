"""Queries: operators bound to the test tables, with SQL for the same rows."""
