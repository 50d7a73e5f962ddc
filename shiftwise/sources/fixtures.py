"""Operational tables derived from the generic benchmark tables.

The benchmark data has no rota, consultation or call tables, so they are
derived, row for row, from customer / supplier / orders / lineitem / labels /
events by fixed rules (one orders row → one shift and two cases, one
lineitem row → one consultation, one events row → one call). Every step is a
projection, a union or a join with the small supplier table, so derivation
adds no shuffle of the large tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwise.functions.exprs import day_floor, ntz_lit
from shiftwise.sources.tables import Tables

# --- Fixed values of the derivation rules ------------------------------------
LOGIN_BASE = datetime(2023, 12, 15)
# consultation type by residue of a key modulo 9 (residue 8 → no type)
TYPE_BY_RESIDUE = (
    "GP Advice",
    "Advice",
    "NWAS Triage",
    "Treatment Centre",
    "CAS Treatment Centre - BARDOC",
    "Visit",
    "HMR VH Visit",
    "Pharmacist Advice",
    None,
)
ROLE_BY_PRIORITY = (
    ("1-URGENT", "Call Handler"),
    ("2-HIGH", "GP"),
    ("3-MEDIUM", "Nurse"),
    ("4-NOT SPECIFIED", "Driver"),
)
OTHER_ROLE = "Pharmacist"
STATUS_BY_RESIDUE = ("Confirmed", "Pending", "Cancelled")
INBOUND_EVENT_TYPES = ("click", "view", "signup")
# ------------------------------------------------------------------------------


def _interval(hours: Column | int = 0, minutes: Column | int = 0, seconds: Column | int = 0) -> Column:
    def lit(v):
        return F.lit(v) if isinstance(v, int) else v

    return F.make_dt_interval(
        F.lit(0), lit(hours).cast("int"), lit(minutes).cast("int"), lit(seconds).cast("decimal(18,6)")
    )


def login_time(k: Column) -> Column:
    return ntz_lit(LOGIN_BASE) + _interval(hours=(k * 37) % 1440, minutes=(k * 7) % 60)


def consultation_type(x: Column) -> Column:
    residue = (x % 9).cast("int")
    expr = None
    for i, label in enumerate(TYPE_BY_RESIDUE):
        if label is None:
            continue
        expr = F.when(residue == i, F.lit(label)) if expr is None else expr.when(residue == i, F.lit(label))
    return expr


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derive_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _read(spark, sf_dir, "customer")
    supplier = _read(spark, sf_dir, "supplier")
    return customer.join(supplier, customer.c_custkey == supplier.s_suppkey, "left").select(
        F.col("c_custkey").alias("personid"),
        F.col("c_name").alias("fullname"),
        F.col("s_name").alias("adastra"),
    )


def derive_rotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    login = login_time(k)
    minutes = F.lit(240) + F.lit(30) * (k % 17)
    hh = F.lpad(F.floor(minutes / 60).cast("int").cast("string"), 2, "0")
    mm = F.lpad((minutes % 60).cast("string"), 2, "0")
    role = None
    for priority, name in ROLE_BY_PRIORITY:
        cond = F.col("o_orderpriority") == priority
        role = F.when(cond, F.lit(name)) if role is None else role.when(cond, F.lit(name))
    status = (
        F.when(k % 3 == 0, F.lit(STATUS_BY_RESIDUE[0]))
        .when(k % 3 == 1, F.lit(STATUS_BY_RESIDUE[1]))
        .otherwise(F.lit(STATUS_BY_RESIDUE[2]))
    )
    return orders.select(
        k.alias("rslid"),
        F.col("o_custkey").alias("personid"),
        day_floor(login).alias("date"),
        login.alias("truelogin"),
        F.when(k % 50 == 0, F.lit(None)).otherwise(login + _interval(minutes=minutes)).alias("truelogout"),
        F.when(k % 97 == 0, F.lit("n/a"))
        .when(k % 3 == 0, F.concat(hh, F.lit(":"), mm))
        .otherwise(F.concat(hh, F.lit(":"), mm, F.lit(":00")))
        .alias("duration"),
        (F.lit(4) + (k % 17) / F.lit(2.0)).cast("double").alias("durationdecimal"),
        F.when(k % 40 == 0, F.lit(""))
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
        .alias("value"),
        role.otherwise(F.lit(OTHER_ROLE)).alias("role"),
        F.col("o_orderstatus").alias("dutystation"),
        status.alias("status"),
    )


def derive_consultations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _read(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    begin = login_time(k) + _interval(minutes=F.lit(20) * F.col("l_linenumber"))
    end = begin + _interval(minutes=F.col("l_quantity").cast("int"), seconds=F.col("l_suppkey") % 60)
    return lineitem.select(
        (F.lit(2) * k + F.col("l_linenumber") % 2).alias("caseno"),
        k.alias("rslid"),
        consultation_type(F.col("l_partkey")).alias("cons_type"),
        consultation_type(F.col("l_suppkey")).alias("next_cons_type"),
        begin.alias("cons_begin_time"),
        end.alias("cons_end_time"),
        F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias(
            "cons_clinicians_name"
        ),
    )


def derive_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    both = orders.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("b"))
    return both.select(
        (F.lit(2) * F.col("o_orderkey") + F.col("b")).alias("caseno"),
        F.col("o_orderdate").alias("active_date"),
        F.col("o_orderstatus").alias("location"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("sex"),
        (F.col("o_custkey") % 90).cast("int").alias("age"),
        consultation_type(F.col("o_custkey")).alias("received_case_type"),
        consultation_type(F.col("o_orderkey")).alias("finished_case_type"),
        F.col("o_orderpriority").alias("priority_on_reception"),
    )


def derive_surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels")
    doc = F.col("doc_id")
    first = labels.select(
        doc.alias("caseno"),
        F.when(doc % 5 == 0, F.lit(None))
        .otherwise(F.lit(1) + F.lit(3) * F.col("quality") + F.col("toxic"))
        .cast("int")
        .alias("satisfaction"),
        F.when(F.col("quality") == 1, F.lit("helpful")).alias("comments"),
    )
    follow_up = labels.filter(doc % 7 == 0).select(
        doc.alias("caseno"), F.lit(3).alias("satisfaction"), F.lit("follow-up").alias("comments")
    )
    return first.unionByName(follow_up)


def derive_phone_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    return events.select(
        F.col("ts").alias("start_time"),
        F.col("user_id").alias("agent_number"),
        F.when(F.col("event_type").isin(*INBOUND_EVENT_TYPES), F.lit("INBOUND"))
        .otherwise(F.lit("OUTBOUND"))
        .alias("direction"),
        F.floor(F.col("value") * 6).cast("int").alias("duration_talk"),
    )


def with_text_forms(t: Tables) -> Tables:
    """Tables whose rota durations are written in eight forms by shift id: units,
    fractions, ISO 8601, days, minus, and one that names no unit."""
    k = F.col("rslid")
    minutes = (F.lit(240) + F.lit(30) * (k % 17)).cast("int")
    h, m = F.floor(minutes / 60).cast("int"), minutes % 60
    forms = (
        F.format_string("%dh%dm", h, m),
        F.format_string("%d min", minutes),
        F.concat(h.cast("string"), F.when(m == 30, F.lit(".5")).otherwise(F.lit("")), F.lit(" hours")),
        F.format_string("PT%dH%dM", h, m),
        F.format_string("1 days %02d:%02d:00", h, m),
        F.format_string("-%d minutes", minutes),
        F.format_string("%d fortnights", minutes),
        F.format_string("%d hr, %d minutes", h, m),
    )
    form = F.element_at(F.array(*forms), (k % 8 + 1).cast("int"))
    return t.with_tables(rotas=t.rotas.withColumn("duration", form))


def rota_date_texts(t: Tables) -> DataFrame:
    """(rslid, date): rota dates as text, most of them day first, some ISO, some none."""
    k = F.col("rslid")
    text = F.when(k % 97 == 0, F.lit("n/a")).when(k % 10 == 0, F.date_format("date", "yyyy-MM-dd")).otherwise(F.date_format("date", "dd/MM/yyyy"))
    return t.rotas.select("rslid", text.alias("date"))


def derive_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All six operational tables derived from the benchmark tables at ``sf_dir``."""
    return Tables.from_frames(
        users=derive_users(spark, sf_dir),
        rotas=derive_rotas(spark, sf_dir),
        consultations=derive_consultations(spark, sf_dir),
        cases=derive_cases(spark, sf_dir),
        surveys=derive_surveys(spark, sf_dir),
        phone_calls=derive_phone_calls(spark, sf_dir),
    )
