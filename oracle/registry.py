"""Oracle SQL per registered report, with the same default arguments."""

from __future__ import annotations

from oracle import cases, clinicians, hourly, rosters
from shiftwise.plans import registry as R

ORACLE: dict[str, str] = {
    "call_stats_hourly": hourly.call_stats_hourly(R.HOURLY_START, R.HOURLY_END),
    "staff_per_hour": hourly.staff_per_hour(R.HOURLY_START, R.HOURLY_END),
    "consult_type_hourly": hourly.consult_type_hourly(R.HOURLY_START, R.HOURLY_END),
    "hourly_activity": hourly.hourly_activity(R.HOURLY_START, R.HOURLY_END),
    "hourly_activity_unaligned": hourly.hourly_activity(R.UNALIGNED_START, R.UNALIGNED_END),
    "hourly_activity_long": hourly.hourly_activity_long(R.HOURLY_START, R.HOURLY_END),
    "calls_by_hour": hourly.calls_by_hour(R.CALLS_START, R.CALLS_END),
    "shift_hours_month": clinicians.shift_hours_month(R.MONTH),
    "consultation_stats_month": clinicians.consultation_stats_month(R.MONTH),
    "clinician_month": clinicians.clinician_month(R.MONTH),
    "shift_consultation_stats": clinicians.shift_consultation_stats(R.MONTH),
    "clinician_shifts": clinicians.clinician_shifts(R.MONTH),
    "clinician_kpis": clinicians.clinician_kpis(R.MONTH),
    "shift_cost_by_date": clinicians.shift_cost_by_date(R.MONTH),
    "shift_location_counts": clinicians.shift_location_counts(R.MONTH),
    "shift_detail": cases.shift_detail(),
    "shift_kpis": cases.shift_kpis(),
    "shift_type_counts": cases.shift_type_counts(),
    "case_detail": cases.case_detail(),
    "case_header": cases.case_header(),
    "case_consultations": cases.case_consultations(),
    "survey_feedback": cases.survey_feedback(),
    "clinicians": rosters.clinicians(),
    "rotas_clinicians": rosters.rotas_clinicians(),
    "rotas_calendar": rosters.rotas_calendar(),
    "month_filter": rosters.month_filter(R.MONTH),
    "month_options": rosters.month_options(),
    "adastra_options": rosters.adastra_options(),
    "duration_hours": rosters.duration_hours(),
    "daily_role_hours_cost": rosters.daily_role_hours_cost(R.HOURLY_START, R.HOURLY_END),
    "clinician_ranking": clinicians.clinician_ranking(R.MONTH),
    "call_agents_daily": hourly.call_agents_daily(R.CALLS_START, R.CALLS_END),
    "duration_hours_forms": rosters.duration_hours_forms(),
    "rota_dates_coerced": rosters.rota_dates_coerced(),
    "coercion_losses": rosters.coercion_losses(R.HOURLY_START, R.HOURLY_END),
}

# the same reports by other ways
for _report, _plain in {
    "clinician_month_layout": "clinician_month",
    "shift_detail_layout": "shift_detail",
    "calls_by_hour_snapshot": "calls_by_hour",
    "calls_by_hour_stored": "calls_by_hour",
    "hourly_activity_stored": "hourly_activity",
    "sql_shift_detail": "shift_detail",
    "sql_call_stats_hourly": "call_stats_hourly",
    "sql_daily_role_hours_cost": "daily_role_hours_cost",
}.items():
    ORACLE[_report] = ORACLE[_plain]
