"""The reports as SQL table functions with typed arguments.

``register(tables)`` names temporary functions for ``spark.sql``:

    spark.sql("SELECT * FROM shift_detail(:shift)", args={"shift": 42})
    spark.sql("SELECT * FROM calls_by_hour(:a, :z)", args={"a": start, "z": end})

Arguments are values of their type, never text of the statement. A function of a
key is a filter on the report of all keys, which the optimizer takes down to the
scans; NULL means all keys. Functions of a range state their half-open range on the raw
column, so it reaches the scan as well.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwise import config
from shiftwise.functions.exprs import duration_micros, hour_floor, money, normalise_duration
from shiftwise.plans import cases, rosters
from shiftwise.sources.tables import Tables

#: function -> (report of all keys, key column, type of the argument)
KEYED = {
    "shift_detail": (cases.shift_detail, "rslid", "BIGINT"),
    "shift_kpis": (cases.shift_kpis, "rslid", "BIGINT"),
    "shift_type_counts": (cases.shift_type_counts, "rslid", "BIGINT"),
    "case_detail": (cases.case_detail, "caseno", "BIGINT"),
    "case_header": (cases.case_header, "caseno", "BIGINT"),
    "case_consultations": (cases.case_consultations, "caseno", "BIGINT"),
    "survey_feedback": (cases.survey_feedback, "caseno", "BIGINT"),
    "clinician_rotas": (rosters.rotas_clinicians, "adastra", "STRING"),
}


def _minutes(seconds: str) -> str:
    return f"CAST(ROUND(CAST({seconds} AS DECIMAL(20,0)) / CAST(60 AS DECIMAL(20,0)), 2) AS DOUBLE)"


def _ranged(view: str) -> dict[str, tuple[str, str]]:
    """function -> (columns, body); ``{f}`` is the function's own name."""
    return {
        "calls_by_hour": (
            "call_hour TIMESTAMP_NTZ, calls_per_hour BIGINT, handlers_per_hour BIGINT",
            f"""SELECT hour_start, COUNT(*), COUNT(DISTINCT agent_number) FROM {view}calls
                WHERE start_time >= {{f}}.range_start AND start_time < {{f}}.range_end GROUP BY hour_start""",
        ),
        "call_stats_hourly": (
            "hour_start TIMESTAMP_NTZ, num_calls BIGINT, total_minutes DOUBLE, total_inbound_minutes DOUBLE",
            f"""SELECT hour_start, COUNT(*), {_minutes('SUM(duration_talk)')},
                       {_minutes(f"SUM(IF(direction <=> '{config.INBOUND}', duration_talk, 0))")}
                FROM {view}calls
                WHERE start_time >= {{f}}.range_start AND start_time < {{f}}.range_end GROUP BY hour_start""",
        ),
        "daily_role_hours_cost": (
            "date TIMESTAMP_NTZ, role STRING, total_hours DOUBLE, total_cost DOUBLE",
            f"""SELECT date, role, COALESCE(SUM(micros), 0) / 3.6E9D, CAST(COALESCE(SUM(cost), 0) AS DOUBLE)
                FROM {view}rota_costs
                WHERE date >= {{f}}.range_start AND date <= {{f}}.range_end AND role IS NOT NULL
                GROUP BY date, role""",
        ),
    }


def register(tables: Tables, prefix: str = "") -> list[str]:
    """Names the functions over ``tables`` in its session, each with ``prefix``."""
    spark, view = tables.rotas.sparkSession, f"_{prefix}sql_"
    tables.phone_calls.withColumn("hour_start", hour_floor("start_time")).createOrReplaceTempView(f"{view}calls")
    micros = duration_micros(normalise_duration("duration"))
    rota_costs = rosters.rotas_clinicians(tables).select("date", "role", micros.alias("micros"), money("value").alias("cost"))
    rota_costs.createOrReplaceTempView(f"{view}rota_costs")
    made = []
    for name, (report, key, kind) in KEYED.items():
        rows, own = report(tables), prefix + name
        rows.createOrReplaceTempView(f"{view}{name}")
        columns = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {own}(wanted {kind}) RETURNS TABLE ({columns}) "
            f"RETURN SELECT * FROM {view}{name} WHERE `{key}` = {own}.wanted OR {own}.wanted IS NULL"
        )
        made.append(own)
    for name, (columns, body) in _ranged(view).items():
        own = prefix + name
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {own}(range_start TIMESTAMP_NTZ, range_end TIMESTAMP_NTZ) "
            f"RETURNS TABLE ({columns}) RETURN {body.format(f=own)}"
        )
        made.append(own)
    return made
