"""Oracle SQL for the rota / clinician lists and daily totals."""

from __future__ import annotations

from datetime import datetime

from oracle.prelude import with_prelude

CLIN = """clin AS (
  SELECT * FROM users WHERE adastra IN (SELECT cons_clinicians_name FROM consultations) GROUP BY ALL
),
rc AS (
  SELECT r.*, u.fullname, u.adastra
  FROM clin u JOIN rotas r ON COALESCE(r.personid = u.personid, r.personid IS NULL AND u.personid IS NULL)
),
cal AS (
  SELECT rc.*, CAST(year(date) AS INTEGER) AS year, strftime(date, '%b') AS month,
         strftime(date, '%B %Y') AS month_year
  FROM rc
)"""

_PATTERN = r"^(-?)(?:(\d+) days? )?(\d+):(\d{1,2}):(\d{1,2})(?:\.(\d{1,6}))?$"

DURATIONS = f"""norm AS (
  SELECT rc.*,
         CASE WHEN len(string_split(COALESCE(duration, 'None'), ':')) = 2
              THEN COALESCE(duration, 'None') || ':00' ELSE COALESCE(duration, 'None') END AS dnorm
  FROM rc
),
parsed AS (
  SELECT norm.*,
    CASE WHEN regexp_full_match(dnorm, '{_PATTERN}') THEN
      (CASE WHEN regexp_extract(dnorm, '{_PATTERN}', 1) = '-' THEN -1 ELSE 1 END) * (
        COALESCE(TRY_CAST(regexp_extract(dnorm, '{_PATTERN}', 2) AS BIGINT), 0) * 86400000000
        + CAST(regexp_extract(dnorm, '{_PATTERN}', 3) AS BIGINT) * 3600000000
        + CAST(regexp_extract(dnorm, '{_PATTERN}', 4) AS BIGINT) * 60000000
        + CAST(regexp_extract(dnorm, '{_PATTERN}', 5) AS BIGINT) * 1000000
        + COALESCE(TRY_CAST(rpad(regexp_extract(dnorm, '{_PATTERN}', 6), 6, '0') AS BIGINT), 0))
    END AS dmicros
  FROM norm
)"""


def clinicians() -> str:
    return with_prelude("SELECT personid, fullname, adastra FROM clin", CLIN)


def rotas_clinicians() -> str:
    return with_prelude("SELECT * FROM rc", CLIN)


def rotas_calendar() -> str:
    return with_prelude("SELECT * FROM cal", CLIN)


def month_filter(month: datetime) -> str:
    return with_prelude(f"SELECT * FROM cal WHERE month_year = '{month.strftime('%B %Y')}'", CLIN)


def month_options() -> str:
    return with_prelude(
        """SELECT CAST(0 AS BIGINT) AS option_index, '(All)' AS month_year
UNION ALL
SELECT ROW_NUMBER() OVER (ORDER BY m DESC) AS option_index, strftime(m, '%B %Y') AS month_year
FROM (SELECT DISTINCT date_trunc('month', date) AS m FROM rc WHERE date IS NOT NULL)""",
        CLIN,
    )


def adastra_options() -> str:
    return with_prelude(
        """SELECT ROW_NUMBER() OVER (ORDER BY adastra) - 1 AS option_index, adastra
FROM (SELECT '(All)' AS adastra UNION SELECT DISTINCT adastra FROM rc WHERE adastra IS NOT NULL)""",
        CLIN,
    )


def duration_hours() -> str:
    return with_prelude(
        """SELECT rslid, personid, dnorm AS duration, CAST(dmicros AS DOUBLE) / 3600000000.0 AS duration_hours
FROM parsed""",
        CLIN + ",\n" + DURATIONS,
    )


def daily_role_hours_cost(start: datetime, end: datetime) -> str:
    s, e = start.strftime("%Y-%m-%d %H:%M:%S"), end.strftime("%Y-%m-%d %H:%M:%S")
    return with_prelude(
        f"""SELECT date, role,
       CAST(COALESCE(SUM(dmicros), 0) AS DOUBLE) / 3600000000.0 AS total_hours,
       CAST(COALESCE(SUM(CAST(NULLIF(value, '') AS DECIMAL(18, 6))), 0) AS DOUBLE) AS total_cost
FROM parsed
WHERE date >= TIMESTAMP '{s}' AND date <= TIMESTAMP '{e}' AND role IS NOT NULL
GROUP BY date, role""",
        CLIN + ",\n" + DURATIONS,
    )


def duration_hours_forms() -> str:
    """Text and hours of each form are written side by side, not parsed."""
    return with_prelude(
        """SELECT rslid, personid,
  CASE rslid % 8
    WHEN 0 THEN (mins // 60) || 'h' || (mins % 60) || 'm'
    WHEN 1 THEN mins || ' min'
    WHEN 2 THEN (mins // 60) || CASE WHEN mins % 60 = 30 THEN '.5' ELSE '' END || ' hours'
    WHEN 3 THEN 'PT' || (mins // 60) || 'H' || (mins % 60) || 'M'
    WHEN 4 THEN '1 days ' || lpad((mins // 60)::VARCHAR, 2, '0') || ':' || lpad((mins % 60)::VARCHAR, 2, '0') || ':00'
    WHEN 5 THEN '-' || mins || ' minutes'
    WHEN 6 THEN mins || ' fortnights'
    ELSE (mins // 60) || ' hr, ' || (mins % 60) || ' minutes' END AS duration,
  CASE rslid % 8 WHEN 4 THEN mins / 60.0::DOUBLE + 24 WHEN 5 THEN -mins / 60.0::DOUBLE WHEN 6 THEN NULL
    ELSE mins / 60.0::DOUBLE END AS duration_hours
FROM (SELECT *, CAST(240 + 30 * (rslid % 17) AS BIGINT) AS mins FROM rc)""",
        CLIN,
    )


def rota_dates_coerced() -> str:
    return with_prelude("SELECT rslid, CASE WHEN rslid % 97 <> 0 AND rslid % 10 <> 0 THEN date END AS date FROM rotas")


def coercion_losses(start: datetime, end: datetime) -> str:
    s, e = start.strftime("%Y-%m-%d %H:%M:%S"), end.strftime("%Y-%m-%d %H:%M:%S")
    return with_prelude(
        f"""SELECT 'duration' AS column_name, COUNT(*) FILTER (duration IS NOT NULL AND dmicros IS NULL) AS n_lost FROM kept
UNION ALL SELECT 'value', COUNT(*) FILTER (value = '') FROM kept""",
        CLIN
        + ",\n"
        + DURATIONS
        + f",\nkept AS (SELECT * FROM parsed WHERE date BETWEEN TIMESTAMP '{s}' AND TIMESTAMP '{e}' AND role IS NOT NULL)",
    )
