"""Relational operators that the jobs and reports share."""
