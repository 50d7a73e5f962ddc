"""Named reports with their default arguments.

Each entry maps a report name to ``Tables -> DataFrame``. Keyed reports
(per shift, per case, per clinician) run for *all* keys at once and group
by the key; a single-key call is the same function with the key given.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame

from shiftwise.functions.coercion import coerce_dates
from shiftwise.plans import cases, clinicians, hourly, rosters, stored
from shiftwise.sources.fixtures import rota_date_texts, with_text_forms
from shiftwise.sources.tables import Tables

# Default arguments of the registered reports.
MONTH = datetime(2024, 1, 1)
HOURLY_START = datetime(2024, 1, 2)
HOURLY_END = datetime(2024, 1, 9)
UNALIGNED_START = datetime(2024, 1, 2, 0, 17)
UNALIGNED_END = datetime(2024, 1, 4, 6, 0)
CALLS_START = datetime(2024, 1, 1)
CALLS_END = datetime(2024, 2, 1)

REPORTS: dict[str, Callable[[Tables], DataFrame]] = {
    "call_stats_hourly": lambda t: hourly.call_stats_hourly(t, HOURLY_START, HOURLY_END),
    "staff_per_hour": lambda t: hourly.staff_per_hour(t, HOURLY_START, HOURLY_END),
    "consult_type_hourly": lambda t: hourly.consult_type_hourly(t, HOURLY_START, HOURLY_END),
    "hourly_activity": lambda t: hourly.hourly_activity(t, HOURLY_START, HOURLY_END),
    "hourly_activity_unaligned": lambda t: hourly.hourly_activity(t, UNALIGNED_START, UNALIGNED_END),
    "hourly_activity_long": lambda t: hourly.hourly_activity_long(t, HOURLY_START, HOURLY_END),
    "calls_by_hour": lambda t: hourly.calls_by_hour(t, CALLS_START, CALLS_END),
    "shift_hours_month": lambda t: clinicians.shift_hours_month(t, MONTH),
    "consultation_stats_month": lambda t: clinicians.consultation_stats_month(t, MONTH),
    "clinician_month": lambda t: clinicians.clinician_month(t, MONTH),
    "shift_consultation_stats": lambda t: clinicians.shift_consultation_stats(t, MONTH),
    "clinician_shifts": lambda t: clinicians.clinician_shifts(t, MONTH),
    "clinician_kpis": lambda t: clinicians.clinician_kpis(t, MONTH),
    "shift_cost_by_date": lambda t: clinicians.shift_cost_by_date(t, MONTH),
    "shift_location_counts": lambda t: clinicians.shift_location_counts(t, MONTH),
    "shift_detail": lambda t: cases.shift_detail(t),
    "shift_kpis": lambda t: cases.shift_kpis(t),
    "shift_type_counts": lambda t: cases.shift_type_counts(t),
    "case_detail": lambda t: cases.case_detail(t),
    "case_header": lambda t: cases.case_header(t),
    "case_consultations": lambda t: cases.case_consultations(t),
    "survey_feedback": lambda t: cases.survey_feedback(t),
    "clinicians": lambda t: rosters.clinicians(t),
    "rotas_clinicians": lambda t: rosters.rotas_clinicians(t),
    "rotas_calendar": lambda t: rosters.rotas_calendar(t),
    "month_filter": lambda t: rosters.month_filter(t, MONTH),
    "month_options": lambda t: rosters.month_options(t),
    "adastra_options": lambda t: rosters.adastra_options(t),
    "duration_hours": lambda t: rosters.duration_hours(t),
    "daily_role_hours_cost": lambda t: rosters.daily_role_hours_cost(t, HOURLY_START, HOURLY_END),
    "clinician_ranking": lambda t: clinicians.clinician_ranking(t, MONTH),
    "clinician_month_layout": lambda t: stored.clinician_month_layout(t, MONTH),
    "shift_detail_layout": lambda t: stored.shift_detail_layout(t),
    "calls_by_hour_snapshot": lambda t: stored.calls_by_hour_snapshot(t, CALLS_START, CALLS_END),
    "calls_by_hour_stored": lambda t: stored.calls_by_hour_stored(t, CALLS_START, CALLS_END),
    "hourly_activity_stored": lambda t: stored.hourly_activity_stored(t, HOURLY_START, HOURLY_END),
    "call_agents_daily": lambda t: stored.call_agents_daily(t, CALLS_START, CALLS_END),
    "sql_shift_detail": lambda t: stored.by_sql(t, "SELECT * FROM shift_detail(:shift)", shift=None),
    "sql_call_stats_hourly": lambda t: stored.by_sql(t, "SELECT * FROM call_stats_hourly(:a, :z)", a=HOURLY_START, z=HOURLY_END),
    "sql_daily_role_hours_cost": lambda t: stored.by_sql(
        t, "SELECT * FROM daily_role_hours_cost(:a, :z)", a=HOURLY_START, z=HOURLY_END
    ),
    "duration_hours_forms": lambda t: rosters.duration_hours(with_text_forms(t)),
    "rota_dates_coerced": lambda t: coerce_dates(rota_date_texts(t), "date"),
    "coercion_losses": lambda t: rosters.coercion_losses(t, HOURLY_START, HOURLY_END),
}
