"""Operators for preparing training text, their queries and the SQL that states their results."""
