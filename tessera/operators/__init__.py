"""Relational operators on coordinate tables (r, c, v)."""
