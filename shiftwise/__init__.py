"""shiftwise: out-of-hours care operations analytics on Spark DataFrames.

Every report is a function ``(Tables, typed arguments) -> DataFrame`` built
from Spark's built-in operators; see ``shiftwise.plans``.
"""

from shiftwise.sources.tables import Tables

__all__ = ["Tables"]
