"""Reports over stored layouts, results and hours below the shared folder.

Each one equals the report of its name over the plain tables. What is stored is
used again by the next call until the tables' files change (results: for an hour).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from shiftwise.functions import sql_reports
from shiftwise.plans import cases, clinicians, hourly
from shiftwise.sources.hour_store import HourStore
from shiftwise.sources.layouts import laid_out
from shiftwise.sources.results import ResultStore
from shiftwise.sources.shared import shared_folder
from shiftwise.sources.tables import Tables


def _below(t: Tables, name: str) -> str:
    return f"{shared_folder(t.rotas.sparkSession)}/{name}"


def clinician_month_layout(t: Tables, month) -> DataFrame:
    """``clinicians.clinician_month`` from the folders of its month."""
    return clinicians.clinician_month(laid_out(t, _below(t, "layout")), month)


def shift_detail_layout(t: Tables, rslid: int | None = None) -> DataFrame:
    """``cases.shift_detail`` from the layout by months and keys."""
    return cases.shift_detail(laid_out(t, _below(t, "layout")), rslid)


def calls_by_hour_snapshot(t: Tables, start, end) -> DataFrame:
    """``hourly.calls_by_hour``, read back from its stored result for an hour."""
    store = ResultStore(t.rotas.sparkSession, _below(t, "results"))
    return store.report(hourly.calls_by_hour, t, start=start, end=end)


def _hours(t: Tables, start, end) -> HourStore:
    store = HourStore(t.rotas.sparkSession, _below(t, "hours"), t)
    store.fill(start, end)
    return store


def calls_by_hour_stored(t: Tables, start, end) -> DataFrame:
    """``hourly.calls_by_hour`` from stored hours; only days not stored are computed."""
    return _hours(t, start, end).calls_by_hour(start, end)


def hourly_activity_stored(t: Tables, start, end) -> DataFrame:
    """``hourly.hourly_activity`` from stored hours."""
    return _hours(t, start, end).hourly_activity(start, end)


def call_agents_daily(t: Tables, start, end) -> DataFrame:
    """Distinct agents per day: the bitmaps of its stored hours put together."""
    return _hours(t, start, end).people_by_period("calls", start, end).withColumnRenamed("people", "agents")


def by_sql(t: Tables, statement: str, **args) -> DataFrame:
    """``statement`` over the reports' table functions, with typed arguments."""
    sql_reports.register(t)
    return t.rotas.sparkSession.sql(statement, args=args)
