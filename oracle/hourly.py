"""Oracle SQL for the hourly reports."""

from __future__ import annotations

from datetime import datetime

from oracle.prelude import r2, ts, with_prelude


def _t(d: datetime) -> str:
    return ts(d.strftime("%Y-%m-%d %H:%M:%S"))


def _call_stats(s, e) -> str:
    """Sums per hour and direction first; the hour's figures from its directions."""
    return f"""directions AS (
  SELECT date_trunc('hour', start_time) AS hour_start, direction, COUNT(*) AS n, SUM(duration_talk) AS secs
  FROM phone_calls WHERE start_time >= {_t(s)} AND start_time < {_t(e)}
  GROUP BY ALL
),
inbound AS (SELECT hour_start, secs AS secs_in FROM directions WHERE direction = 'INBOUND'),
hour_sums AS (SELECT hour_start, SUM(n)::BIGINT AS num_calls, SUM(secs) AS secs FROM directions GROUP BY hour_start),
call_stats AS (
  SELECT hour_start, num_calls, {r2('secs', '60')} AS total_minutes,
         {r2('COALESCE(secs_in, 0)', '60')} AS total_inbound_minutes
  FROM hour_sums LEFT JOIN inbound USING (hour_start)
)"""


def _grid(s, e) -> str:
    hours = int((e - s).total_seconds() // 3600) + 1
    return f"""grid AS (SELECT {_t(s)} + to_hours(CAST(k AS INTEGER)) AS hour_start FROM range({hours}) AS t(k))"""


def _staff() -> str:
    """The overlap itself: shifts that begin by the hour's last minute and end after
    the minute before it. The engine lays shifts out over hours by arithmetic."""
    return """handlers AS (
  SELECT DISTINCT grid.hour_start, personid
  FROM grid, rotas
  WHERE role = 'Call Handler' AND truelogin <= hour_start + INTERVAL 59 MINUTE AND truelogout > hour_start - INTERVAL 1 MINUTE
),
staff AS (
  SELECT hour_start, COUNT(personid) AS num_staff FROM grid LEFT JOIN handlers USING (hour_start) GROUP BY hour_start
)"""


# Consultation type and the column that counts it.
TYPE_COLUMNS = (
    ("GP Advice", "gp_advice_consults"),
    ("Advice", "advice_consults"),
    ("Visit", "visit"),
    ("Treatment Centre", "treatment_centre"),
    ("NWAS Triage", "nwas_triage"),
)


def _cons(s, e) -> str:
    """A tally of all types of each hour, then the columns out of it."""
    picked = ", ".join(f"COALESCE(tally['{kind}'], 0)::BIGINT AS {name}" for kind, name in TYPE_COLUMNS)
    return f"""tallies AS (
  SELECT date_trunc('hour', cons_begin_time) AS hour_start, histogram(cons_type) AS tally
  FROM consultations WHERE cons_begin_time >= {_t(s)} AND cons_begin_time < {_t(e)}
  GROUP BY ALL
),
cons AS (SELECT hour_start, {picked} FROM tallies)"""


def call_stats_hourly(s, e) -> str:
    return with_prelude(
        "SELECT hour_start, num_calls, total_minutes, total_inbound_minutes FROM call_stats",
        _call_stats(s, e),
    )


def staff_per_hour(s, e) -> str:
    return with_prelude("SELECT hour_start, num_staff FROM staff", _grid(s, e) + ",\n" + _staff())


def consult_type_hourly(s, e) -> str:
    return with_prelude("SELECT * FROM cons", _cons(s, e))


def _hourly_body() -> str:
    """Every source gives the measures it has; each hour of the grid sums them up."""
    measures = ["num_calls", "total_minutes", "total_inbound_minutes", "num_staff", *[n for _, n in TYPE_COLUMNS]]
    sums = ",\n    ".join(f"COALESCE(SUM({m}), 0) AS {m}" for m in measures)
    counts = ", ".join(f"{n}::BIGINT AS {n}" for _, n in TYPE_COLUMNS)
    # rounded minutes are whole cents, so the division is exact on integers
    per_handler = r2("CAST(round(total_inbound_minutes * 100) AS BIGINT)", "100 * NULLIF(num_staff, 0)::BIGINT")
    return f"""
  SELECT strftime(hour_start, '%Y-%m-%d %H:00') AS hour, num_calls::BIGINT AS num_calls, total_minutes,
         total_inbound_minutes, num_staff::BIGINT AS num_call_handlers,
         COALESCE({per_handler}, 0.0) AS inbound_minutes_per_handler, {counts}
  FROM (
    SELECT hour_start, {sums}
    FROM (
      SELECT hour_start, num_staff FROM staff
      UNION ALL BY NAME
      SELECT * FROM call_stats WHERE hour_start IN (SELECT hour_start FROM grid)
      UNION ALL BY NAME
      SELECT * FROM cons WHERE hour_start IN (SELECT hour_start FROM grid)
    )
    GROUP BY hour_start
  )"""


def _hourly_ctes(s, e) -> str:
    return ",\n".join([_grid(s, e), _call_stats(s, e), _staff(), _cons(s, e)])


def hourly_activity(s, e) -> str:
    return with_prelude(_hourly_body(), _hourly_ctes(s, e))


def hourly_activity_long(s, e) -> str:
    shown = "num_calls, gp_advice_consults, advice_consults, visit, treatment_centre"
    ctes = _hourly_ctes(s, e) + ",\nwide AS (" + _hourly_body() + ")"
    return with_prelude(
        f"""SELECT hour, metric, value
FROM (SELECT hour, {shown} FROM wide) UNPIVOT (value FOR metric IN ({shown}))""",
        ctes,
    )


def calls_by_hour(s, e) -> str:
    return with_prelude(
        f"""SELECT date_trunc('hour', start_time) AS call_hour,
       COUNT(*) AS calls_per_hour,
       COUNT(DISTINCT agent_number) AS handlers_per_hour
FROM phone_calls
WHERE start_time >= {_t(s)} AND start_time < {_t(e)}
GROUP BY 1"""
    )


def call_agents_daily(s, e) -> str:
    return with_prelude(
        f"""SELECT CAST(start_time AS DATE)::TIMESTAMP AS period, COUNT(DISTINCT agent_number) AS agents
FROM phone_calls WHERE start_time >= {_t(s)} AND start_time < {_t(e)} GROUP BY period"""
    )
