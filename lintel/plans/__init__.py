"""Registered queries: operators bound to tables, with the SQL that states the expected result."""
