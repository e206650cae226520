"""Operators from DataFrame to DataFrame; none of them collects rows."""
