"""Edge cases on hand-made tables, checked against brute force in Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shiftwise.operators.joins import left_join_skew_safe
from shiftwise.operators.numbering import number_within
from shiftwise.plans import cases, clinicians, hourly, rosters
from tests.util import make_tables

H = timedelta(hours=1)
M = timedelta(minutes=1)


def rota(rslid, personid, login, logout, role="Call Handler", value="10.00", dd=8.0, duration="08:00"):
    return dict(
        rslid=rslid,
        personid=personid,
        date=None if login is None else datetime(login.year, login.month, login.day),
        truelogin=login,
        truelogout=logout,
        duration=duration,
        durationdecimal=dd,
        value=value,
        role=role,
        dutystation="F",
        status="Confirmed",
    )


def brute_staff(rotas, start, end):
    out = {}
    h = start
    while h <= end:
        people = {
            r["personid"]
            for r in rotas
            if r["role"] == "Call Handler"
            and r["personid"] is not None
            and r["truelogin"] is not None
            and r["truelogout"] is not None
            and r["truelogin"] + M <= h + H
            and r["truelogout"] + M > h
        }
        out[h] = len(people)
        h += H
    return out


@pytest.mark.parametrize(
    "start, end",
    [
        (datetime(2024, 1, 2), datetime(2024, 1, 4)),
        (datetime(2024, 1, 2, 0, 17, 30), datetime(2024, 1, 3, 6)),
        (datetime(2024, 1, 2, 5), datetime(2024, 1, 2, 5)),
    ],
)
def test_staff_binned_equals_theta_join(spark, start, end):
    rng = random.Random(7)
    rows = []
    base = datetime(2024, 1, 1, 12)
    for i in range(300):
        login = base + timedelta(minutes=rng.randrange(0, 60 * 72))
        logout = login + timedelta(minutes=rng.randrange(-90, 60 * 14))
        if i % 37 == 0:
            login = None
        if i % 41 == 0:
            logout = None
        role = "Call Handler" if i % 4 else "GP"
        rows.append(rota(i, None if i % 53 == 0 else i % 25, login, logout, role=role))
    # boundary shifts: 08:59 login touches 08:00; 09:00:00 logout touches 09:00
    rows.append(rota(1000, 900, datetime(2024, 1, 2, 8, 59), datetime(2024, 1, 2, 9, 0)))
    t = make_tables(spark, rotas=rows)
    got = {r["hour_start"]: r["num_staff"] for r in hourly.staff_per_hour(t, start, end).collect()}
    assert got == brute_staff(rows, start, end)


def test_reversed_range_is_empty(spark):
    t = make_tables(spark, rotas=[rota(1, 1, datetime(2024, 1, 2, 8), datetime(2024, 1, 2, 16))])
    assert hourly.hourly_activity(t, datetime(2024, 1, 3), datetime(2024, 1, 2)).count() == 0


def test_last_hour_has_staff_but_no_calls(spark):
    start, end = datetime(2024, 1, 2, 8), datetime(2024, 1, 2, 10)
    t = make_tables(
        spark,
        rotas=[rota(1, 1, datetime(2024, 1, 2, 7), datetime(2024, 1, 2, 12))],
        phone_calls=[
            dict(start_time=datetime(2024, 1, 2, 8, 5), agent_number=1, direction="INBOUND", duration_talk=90),
            dict(start_time=datetime(2024, 1, 2, 10, 5), agent_number=1, direction="INBOUND", duration_talk=60),
            dict(start_time=datetime(2024, 1, 2, 8, 6), agent_number=2, direction="OUTBOUND", duration_talk=None),
        ],
    )
    rows = {r["hour"]: r for r in hourly.hourly_activity(t, start, end).collect()}
    assert rows["2024-01-02 10:00"]["num_calls"] == 0
    assert rows["2024-01-02 10:00"]["num_call_handlers"] == 1
    assert rows["2024-01-02 08:00"]["num_calls"] == 2
    assert rows["2024-01-02 08:00"]["total_minutes"] == 1.5
    assert rows["2024-01-02 08:00"]["inbound_minutes_per_handler"] == 1.5


def cons(caseno, rslid, begin, minutes, ctype="GP Advice", nxt=None, name="Dr A"):
    return dict(
        caseno=caseno,
        rslid=rslid,
        cons_type=ctype,
        next_cons_type=nxt,
        cons_begin_time=begin,
        cons_end_time=None if begin is None else begin + timedelta(minutes=minutes),
        cons_clinicians_name=name,
    )


def test_shift_without_consultations(spark):
    t = make_tables(spark, rotas=[rota(5, 1, datetime(2024, 1, 2, 8), datetime(2024, 1, 2, 16))])
    rows = cases.shift_detail(t, 5).collect()
    assert len(rows) == 1 and rows[0]["case_number"] is None
    k = cases.shift_kpis(t, 5).first()
    assert (k["total_cases"], k["total_consultation_mins"], k["avg_consultation_mins"]) == (0, 0.0, None)


def test_case_with_two_surveys_and_two_consultations(spark):
    t0 = datetime(2024, 1, 2, 9)
    t = make_tables(
        spark,
        cases=[dict(caseno=7, age=40, location="X"), dict(caseno=8, age=50)],
        consultations=[cons(7, 1, t0 + timedelta(minutes=30), 12), cons(7, 1, t0, 10), cons(7, 1, None, 0)],
        surveys=[dict(caseno=7, satisfaction=4), dict(caseno=7, comments="ok")],
        users=[dict(personid=11, fullname="A", adastra="Dr A")],
    )
    detail = cases.case_detail(t, 7).collect()
    assert len(detail) == 6  # 3 consultations x 2 surveys, order by begin, missing begin last
    assert detail[0]["cons_begin_time"] == t0 and detail[-1]["cons_begin_time"] is None
    assert {r["clinician_personid"] for r in detail} == {11}
    head = cases.case_header(t, 7).first()
    assert head["consultation_duration_mins"] == 10.0
    numbered = cases.case_consultations(t, 7).collect()
    assert [r["consultation_no"] for r in numbered] == [1, 2, 3, 4, 5, 6]
    assert cases.case_detail(t, 8).count() == 1  # a case without consultations keeps one row
    assert cases.case_header(t, 8).first()["consultation_duration_mins"] is None
    assert cases.survey_feedback(t, 7).count() == 6


def test_duplicate_clinician_names_fail(spark):
    login = datetime(2024, 1, 2, 8)
    t = make_tables(
        spark,
        users=[dict(personid=1, fullname="Same"), dict(personid=2, fullname="Same")],
        rotas=[rota(1, 1, login, login + 8 * H), rota(2, 2, login, login + 8 * H)],
        consultations=[cons(10, 1, login, 5), cons(11, 2, login, 5)],
    )
    with pytest.raises(Exception, match="more than one person"):
        clinicians.clinician_month(t, datetime(2024, 1, 1)).collect()


def test_blank_cost_and_zero_hours(spark):
    login = datetime(2024, 1, 2, 8)
    t = make_tables(
        spark,
        users=[dict(personid=1, fullname="P")],
        rotas=[rota(1, 1, login, login + 8 * H, value="", dd=0.0), rota(2, 1, login, login + 8 * H, value="20.50")],
        consultations=[cons(10, 1, login, 30), cons(11, 2, login, 45, ctype="Visit")],
    )
    rows = {r["rslid"]: r for r in clinicians.clinician_shifts(t, datetime(2024, 1, 1), 1).collect()}
    assert rows[1]["shift_cost"] is None and rows[1]["consultation_time_percentage"] is None
    assert rows[2]["cost_per_consultation"] == 20.5
    month = clinicians.clinician_month(t, datetime(2024, 1, 1)).first()
    assert month["total_cost"] == 20.5 and month["total_shifts"] == 2
    kpi = clinicians.clinician_kpis(t, datetime(2024, 1, 1), 1).first()
    assert kpi["total_cost"] == 20.5 and kpi["total_consultations"] == 2


def test_null_person_ids_pair_in_rota_merge(spark):
    t = make_tables(
        spark,
        users=[dict(personid=None, fullname="Nobody", adastra="Dr N")],
        rotas=[rota(1, None, datetime(2024, 1, 2, 8), datetime(2024, 1, 2, 9))],
        consultations=[cons(1, 1, datetime(2024, 1, 2, 8), 5, name="Dr N")],
    )
    rows = rosters.rotas_clinicians(t).collect()
    assert len(rows) == 1 and rows[0]["fullname"] == "Nobody"


def test_number_within_equals_row_number_with_hot_key(spark):
    rng = random.Random(3)
    data = [(0 if i % 3 else rng.randrange(1, 50), rng.randrange(0, 1000), i) for i in range(5000)]
    df = spark.createDataFrame(data, "g long, v long, id long")
    got = number_within(df, ["g"], [F.col("v").asc(), F.col("id").asc()], [F.floor(F.col("v") / 50)])
    w = Window.partitionBy("g").orderBy("v", "id")
    want = df.withColumn("row_no", F.row_number().over(w))
    assert sorted(got.collect()) == sorted(want.collect())


def test_left_join_skew_safe_equals_left_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, x string")
    right = spark.createDataFrame([(1, 10), (1, 11), (3, 30), (None, 0)], "k long, y long")
    got = left_join_skew_safe(left, right, ["k"])
    want = left.join(right, "k", "left")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_costs_keep_their_digits_or_fail(spark):
    from shiftwise.functions.exprs import money

    df = spark.createDataFrame([("1.23456789",), ("1234567890123.5",), ("",), (None,), ("2.5000000000000",), ("1e3",)], "v string")
    got = [None if r[0] is None else str(r[0].normalize()) for r in df.select(money("v")).collect()]
    assert got == ["1.23456789", "1234567890123.5", None, None, "2.5", "1E+3"]
    for bad in ("1.23456789012", "12345678901234567890", "1e-12", "ten"):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "v string").select(money("v")).collect()


def test_durations_out_of_range_are_missing(spark):
    from shiftwise.functions.exprs import duration_micros

    texts = ["99999999999999999999:00:00", "3000000000:00:00", "99999999999 days 1:00:00", "2 days 1:00:00", "-0:01:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(duration_micros("t")).collect()] == [None, None, None, 49 * 3600 * 10**6, -60 * 10**6]


def test_month_none_is_the_default_month(spark):
    from shiftwise.functions.exprs import resolve_month

    day = resolve_month(None) + timedelta(hours=9)
    t = make_tables(spark, rotas=[rota(1, 5, day, day + 8 * H)], users=[dict(personid=5, fullname="A", adastra="a")])
    assert clinicians.shift_hours_month(t, None).collect() == clinicians.shift_hours_month(t, day).collect() != []


def test_a_shared_name_matters_only_in_the_statistics(spark):
    day = datetime(2024, 1, 3, 9)
    users = [dict(personid=1, fullname="Same", adastra="s1"), dict(personid=2, fullname="Same", adastra="s2"), dict(personid=3, fullname="Own", adastra="o")]
    rotas = [rota(i, i, day, day + 8 * H) for i in (1, 2, 3)]
    cons = [dict(rslid=3, caseno=1, cons_type="Advice", cons_begin_time=day, cons_end_time=day + H)]
    t = make_tables(spark, users=users, rotas=rotas, consultations=cons)
    assert [r.clinician_name for r in clinicians.consultation_stats_month(t, "2024-01-01").collect()] == ["Own"]
    t = make_tables(spark, users=users, rotas=rotas, consultations=cons + [dict(cons[0], rslid=1)])
    with pytest.raises(Exception, match="more than one person"):
        clinicians.consultation_stats_month(t, "2024-01-01").collect()


def test_text_that_is_no_date_is_missing(spark):
    from shiftwise import schemas
    from shiftwise.sources.tables import conform

    df = spark.createDataFrame([("2024-01-02 03:04:05", 1), ("soon", 2)], "date string, rslid long")
    assert [r.date for r in conform(df, schemas.ALL["rotas"]).orderBy("rslid").collect()] == [datetime(2024, 1, 2, 3, 4, 5), None]


def test_case_header_takes_the_first_consultation(spark):
    day = datetime(2024, 1, 3, 9)
    times = {1: [(day, day + H), (day, day + 2 * H), (day - H, None)], 2: [(None, day), (day, day + M)], 3: [(None, None)], 4: []}
    cons = [dict(caseno=c, cons_begin_time=b, cons_end_time=e) for c, v in times.items() for b, e in v]
    t = make_tables(spark, cases=[dict(caseno=c) for c in times], consultations=cons)
    got = {r.caseno: r.consultation_duration_mins for r in cases.case_header(t).collect()}
    assert got == {1: None, 2: 1.0, 3: None, 4: None}
    assert cases.case_header(t, 2).first().consultation_duration_mins == 1.0
