"""Incremental versions of the hourly call statistics."""
