"""Drill-downs: a shift with its consultations, a case with its
consultations, clinicians and surveys, and their summaries.

Every function takes an optional key (``rslid`` / ``caseno``). Given, the
key is a filter that reaches the scan and the rows come back in
consultation order. ``None`` runs the drill-down for all keys in one job
(no global order is imposed then).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftwise.functions.exprs import hour_floor, micros_between, minutes2, ntz_lit, to_double
from shiftwise.operators.joins import left_join_skew_safe
from shiftwise.operators.numbering import number_within
from shiftwise.sources.tables import Tables


def _keyed(df: DataFrame, column: str, key: int | None) -> DataFrame:
    return df if key is None else df.filter(F.col(column) == F.lit(key).cast("long"))


def _minutes() -> F.Column:
    return minutes2(micros_between("cons_begin_time", "cons_end_time"))


# --- shift ---------------------------------------------------------------------------


def shift_detail(t: Tables, rslid: int | None = None) -> DataFrame:
    """A shift (or every shift) with its consultations; a shift without any
    gives one row with empty consultation columns."""
    shifts = _keyed(t.rotas, "rslid", rslid).select(
        "personid",
        "rslid",
        F.col("truelogin").alias("shift_start_time"),
        F.col("truelogout").alias("shift_end_time"),
    )
    cons = _keyed(t.consultations, "rslid", rslid).select(
        "rslid",
        F.col("caseno").alias("case_number"),
        F.col("cons_type").alias("consultation_type"),
        F.col("next_cons_type").alias("next_consultation_type"),
        F.col("cons_begin_time").alias("consultation_start"),
        F.col("cons_end_time").alias("consultation_end"),
        to_double(_minutes()).alias("consultation_duration_mins"),
    )
    rows = left_join_skew_safe(shifts, cons, ["rslid"], one_key=rslid is not None)
    if rslid is not None:
        rows = rows.orderBy(F.col("consultation_start").asc_nulls_last())
    return rows.select(
        "personid",
        "rslid",
        "shift_start_time",
        "shift_end_time",
        "case_number",
        "consultation_type",
        "next_consultation_type",
        "consultation_start",
        "consultation_end",
        "consultation_duration_mins",
    )


def _shift_rows(t: Tables, rslid: int | None) -> DataFrame:
    """Rota rows per shift id (normally 1): each repeats the shift's consultations."""
    return _keyed(t.rotas, "rslid", rslid).groupBy("rslid").agg(F.count(F.lit(1)).alias("_rows"))


def shift_kpis(t: Tables, rslid: int | None = None) -> DataFrame:
    """Per shift: distinct cases, total and mean consultation minutes.

    Consultations are aggregated per shift first (partial aggregation, so a
    busy shift is combined map-side) and only then meet the shift table.
    """
    per_shift = (
        _keyed(t.consultations, "rslid", rslid)
        .select("rslid", "caseno", _minutes().alias("mins"))
        .groupBy("rslid")
        .agg(
            F.countDistinct("caseno").alias("total_cases"),
            F.sum("mins").alias("mins_sum"),
            F.count("mins").alias("mins_n"),
        )
    )
    j = _shift_rows(t, rslid).join(per_shift, "rslid", "left")
    total = F.coalesce(F.col("mins_sum") * F.col("_rows"), F.lit(0))
    mean = F.col("mins_sum").cast("double") / F.nullif(F.col("mins_n"), F.lit(0)).cast("double")
    return j.select(
        "rslid",
        F.coalesce(F.col("total_cases"), F.lit(0)).cast("long").alias("total_cases"),
        to_double(total).alias("total_consultation_mins"),
        mean.alias("avg_consultation_mins"),
    )


def shift_type_counts(t: Tables, rslid: int | None = None) -> DataFrame:
    """Consultations per type within each shift (missing types left out)."""
    per_type = (
        _keyed(t.consultations, "rslid", rslid)
        .filter(F.col("cons_type").isNotNull())
        .groupBy("rslid", F.col("cons_type").alias("consultation_type"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    j = per_type.join(_shift_rows(t, rslid), "rslid")
    out = j.select("rslid", "consultation_type", (F.col("_n") * F.col("_rows")).alias("consultation_count"))
    if rslid is not None:
        out = out.orderBy(F.col("consultation_count").desc())
    return out


# --- case ------------------------------------------------------------------------------

# The columns of a case and of a consultation, in the order of
# the result.
CASE_COLUMNS = (
    "caseno",
    "active_date",
    "location",
    "sex",
    "age",
    "call_origin",
    "clinical_codes",
    "comfort_call",
    "dx_outcome",
    "received_case_type",
    "finished_case_type",
    "priority_on_reception",
    "priority_after_assessment",
    "priority_on_completion",
    "od_start_time",
    "od_finish_time",
    "ccg",
    "provider_group",
    "informational_outcome",
    "cons_delay",
    "od_cons_delay",
    "cons_delayafter_assess",
)

# consultation column -> output name (renamed where a case column has the name)
CONSULTATION_COLUMNS = (
    ("rslid", "rslid"),
    ("case_type", "case_type"),
    ("active_date", "cons_active_date"),
    ("call_origin", "cons_call_origin"),
    ("location_name", "location_name"),
    ("operator_who_received_case", "operator_who_received_case"),
    ("receive_time", "receive_time"),
    ("reported_condition", "reported_condition"),
    ("priority_on_reception", "cons_priority_reception"),
    ("priority_after_assessment", "cons_priority_assessment"),
    ("priority_on_completion", "cons_priority_completion"),
    ("patient_audit_allergy", "patient_audit_allergy"),
    ("patient_audit_condition", "patient_audit_condition"),
    ("patient_audit_medication", "patient_audit_medication"),
    ("cons_type", "cons_type"),
    ("next_cons_type", "next_cons_type"),
    ("cons_begin_time", "cons_begin_time"),
    ("cons_end_time", "cons_end_time"),
    ("cons_clinicians_name", "cons_clinicians_name"),
    ("cons_history", "cons_history"),
    ("cons_examination", "cons_examination"),
    ("cons_diagnosis", "cons_diagnosis"),
    ("cons_treatment", "cons_treatment"),
    ("clinical_codes", "cons_clinical_codes"),
    ("cons_prescriptions", "cons_prescriptions"),
    ("prescriptions", "prescriptions"),
    ("informational_outcomes", "informational_outcomes"),
)

CASE_DETAIL_COLUMNS = (
    CASE_COLUMNS
    + ("clinician_personid",)
    + tuple(out for _, out in CONSULTATION_COLUMNS)
    + ("satisfaction", "survey_comments", "consultation_duration_mins")
)


def _case_rows(t: Tables, caseno: int | None) -> DataFrame:
    cases = _keyed(t.cases, "caseno", caseno).select(*CASE_COLUMNS)
    cons = _keyed(t.consultations, "caseno", caseno).select(
        "caseno",
        *[F.col(src).alias(out) for src, out in CONSULTATION_COLUMNS],
        _minutes().alias("consultation_duration_mins"),
    )
    surveys = _keyed(t.surveys, "caseno", caseno).select(
        "caseno", "satisfaction", F.col("comments").alias("survey_comments")
    )
    # cases meet their surveys first; dealt anew, they leave the join with the
    # consultations an exchange of its own on each side, so a hot case can be split
    rated = cases.join(surveys, "caseno", "left")
    if caseno is None:
        rated = rated.repartition("caseno", "satisfaction")
    rows = left_join_skew_safe(rated, cons, ["caseno"], one_key=caseno is not None)
    return _with_clinician(t, rows)


def _with_clinician(t: Tables, rows: DataFrame) -> DataFrame:
    users = t.users.filter(F.col("adastra").isNotNull()).select(
        F.col("adastra").alias("_adastra"), F.col("personid").alias("clinician_personid")
    )
    return rows.join(users, rows["cons_clinicians_name"] == users["_adastra"], "left")


def case_detail(t: Tables, caseno: int | None = None) -> DataFrame:
    """A case (or every case) with its consultations, the consulting
    clinician's id and the case's surveys (consultations × surveys)."""
    rows = _case_rows(t, caseno)
    if caseno is not None:
        rows = rows.orderBy(F.col("cons_begin_time").asc_nulls_last())
    return rows.select(
        *[
            to_double(F.col(c)).alias(c) if c == "consultation_duration_mins" else F.col(c)
            for c in CASE_DETAIL_COLUMNS
        ]
    )


HEADER_COLUMNS = (
    "age",
    "location",
    "sex",
    "dx_outcome",
    "received_case_type",
    "finished_case_type",
    "priority_on_reception",
    "priority_after_assessment",
    "priority_on_completion",
)


_MISSING = 9 * 10**18  # later than any packed time


def case_header(t: Tables, caseno: int | None = None) -> DataFrame:
    """The header of the case page: case fields and the duration of the
    first consultation (earliest begin, missing begin last).

    Begin and end are packed in one decimal whose order is theirs (missing
    last), so the first consultation is a plain minimum: a hash aggregate that
    combines map-side and sorts nothing.
    """
    epoch = ntz_lit("1970-01-01")

    def since(c: str) -> F.Column:  # microseconds, above 0 for any date; missing last
        us = micros_between(epoch, c) + F.lit(10**18)
        return F.coalesce(us, F.lit(_MISSING)).cast("decimal(19,0)")

    unit = F.expr("CAST(10000000000000000000 AS DECIMAL(20,0))")
    key = (since("cons_begin_time") * unit + since("cons_end_time")).cast("decimal(38,0)")
    packed = _keyed(t.consultations, "caseno", caseno).groupBy("caseno").agg(F.min(key).alias("_first"))
    begin = F.expr("_first div CAST(10000000000000000000 AS DECIMAL(20,0))")
    split = packed.select("caseno", "_first", begin.alias("_begin")).withColumn(
        "_end", (F.col("_first") - F.col("_begin").cast("decimal(19,0)") * unit).cast("long")
    )
    known = (F.col("_begin") != _MISSING) & (F.col("_end") != _MISSING)
    first = split.select("caseno", F.when(known, minutes2(F.col("_end") - F.col("_begin"))).alias("first_mins"))
    cases = _keyed(t.cases, "caseno", caseno)
    j = cases.join(first, "caseno", "left")
    return j.select(
        "caseno",
        to_double(F.col("first_mins")).alias("consultation_duration_mins"),
        *HEADER_COLUMNS,
    )


def _begin_hour() -> list:
    """Slices of a case: the hours in which its consultations begin, missing last."""
    return [F.col("cons_begin_time").isNull(), hour_floor("cons_begin_time")]


def _rows_per_hour(t: Tables, caseno: int | None) -> DataFrame:
    """Rows of ``_case_rows`` per case and hour, from counts of the tables: case rows
    x its surveys x its consultations of the hour, each as often as its clinician is listed."""

    def per_case(df: DataFrame, out: str) -> DataFrame:
        return _keyed(df, "caseno", caseno).groupBy("caseno").agg(F.count(F.lit(1)).alias(out))

    listed = t.users.filter(F.col("adastra").isNotNull()).groupBy(F.col("adastra").alias("_name")).agg(F.count(F.lit(1)).alias("_listed"))
    isnull, hour = _begin_hour()
    cons = _keyed(t.consultations, "caseno", caseno).select("caseno", "cons_clinicians_name", isnull.alias("_slice0"), hour.alias("_slice1"))
    named = cons.join(listed, F.col("cons_clinicians_name") == F.col("_name"), "left")
    hours = named.groupBy("caseno", "_slice0", "_slice1").agg(F.sum(F.coalesce("_listed", F.lit(1))).alias("_cons"))
    copies = per_case(t.cases, "_cases").join(per_case(t.surveys, "_surveys"), "caseno", "left")
    return copies.join(hours, "caseno", "left").select(
        "caseno",
        F.coalesce("_slice0", F.lit(True)).alias("_slice0"),
        "_slice1",
        (F.col("_cases") * F.coalesce("_surveys", F.lit(1)) * F.coalesce("_cons", F.lit(1))).alias("_n"),
    )


def case_consultations(t: Tables, caseno: int | None = None) -> DataFrame:
    """One row per consultation entry of the case page, numbered in
    consultation order. ``consultation_type`` is the case's received type
    (what the page prints under that label); ``cons_type`` is also given."""
    rows = _case_rows(t, caseno).select(
        "caseno",
        "cons_begin_time",
        "cons_end_time",
        F.col("received_case_type").alias("consultation_type"),
        "cons_type",
        "cons_clinicians_name",
        "cons_diagnosis",
        "cons_treatment",
        "satisfaction",
        "survey_comments",
    )
    order = [
        F.col(c).asc_nulls_last()
        for c in (
            "cons_begin_time",
            "cons_end_time",
            "cons_type",
            "cons_clinicians_name",
            "cons_diagnosis",
            "cons_treatment",
            "satisfaction",
            "survey_comments",
        )
    ]
    numbered = number_within(
        rows, ["caseno"], order, _begin_hour(), out="consultation_no", counts=_rows_per_hour(t, caseno)
    )
    if caseno is not None:
        numbered = numbered.orderBy("consultation_no")
    return numbered


def survey_feedback(t: Tables, caseno: int | None = None) -> DataFrame:
    """Case page rows that carry a satisfaction score or a comment."""
    surveys = (
        _keyed(t.surveys, "caseno", caseno)
        .filter(F.col("satisfaction").isNotNull() | F.col("comments").isNotNull())
        .select("caseno", "satisfaction", F.col("comments").alias("survey_comments"))
    )
    rated = _keyed(t.cases, "caseno", caseno).select("caseno").join(surveys, "caseno")
    cons = _keyed(t.consultations, "caseno", caseno).select("caseno", "cons_begin_time", "cons_clinicians_name")
    cons = cons.join(surveys.select("caseno").distinct(), "caseno", "left_semi")
    rows = left_join_skew_safe(rated, cons, ["caseno"], one_key=caseno is not None)
    return _with_clinician(t, rows).select("caseno", "cons_begin_time", "satisfaction", "survey_comments")
