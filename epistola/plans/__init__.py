"""Registered queries: the library's operators over the driver's tables, and the same in SQL."""
