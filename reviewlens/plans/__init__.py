"""Registered queries with their check SQL, grouped by operator family."""
