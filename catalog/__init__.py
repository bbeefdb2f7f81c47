"""The operators bound to the test tables, and the same questions in SQL."""
