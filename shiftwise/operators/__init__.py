"""Reusable relational building blocks of the reports."""
