"""Stored hours: any range put together equals the direct report."""

from datetime import date, datetime, timedelta

import pytest

from shiftwise.plans import hourly
from shiftwise.sources.hour_store import HourStore
from tests.util import make_tables, rows

D = [datetime(2024, 1, d) for d in range(1, 12)]


@pytest.fixture
def store(spark, small_tables, tmp_path):
    return HourStore(spark, str(tmp_path / "hours"), small_tables)


def test_union_of_stored_hours_equals_the_report(store, small_tables):
    assert store.fill(D[1], D[3]) == [date(2024, 1, 2), date(2024, 1, 3), date(2024, 1, 4)]
    assert store.fill(D[6], D[7]) == [date(2024, 1, 7), date(2024, 1, 8)]
    # overlapping: only what lacks is computed, around days that are stored
    assert store.fill(D[0], D[8]) == [date(2024, 1, x) for x in (1, 5, 6, 9)]
    assert store.fill(D[0], D[8]) == []
    for s, e in ((D[0], D[8]), (D[2] + timedelta(hours=5), D[4] + timedelta(hours=7)), (D[3], D[3])):
        for report in ("call_stats_hourly", "calls_by_hour", "staff_per_hour", "hourly_activity"):
            assert rows(getattr(store, report)(s, e)) == rows(getattr(hourly, report)(small_tables, s, e)), (report, s, e)


def test_days_are_not_computed_twice(store, small_tables, monkeypatch):
    from shiftwise.sources import hour_store

    ranges = []
    real = hour_store._COMPUTE["calls"]
    monkeypatch.setitem(hour_store._COMPUTE, "calls", lambda t, s, e: ranges.append((s, e)) or real(t, s, e))
    store.fill(D[1], D[2])
    store.fill(D[1], D[4])
    assert ranges == [(D[1], D[3]), (D[3], D[5])]


def test_distinct_people_over_longer_periods(store, small_tables):
    store.fill(D[0], D[9])
    calls = [(r["start_time"], r["agent_number"]) for r in small_tables.phone_calls.collect()]
    for unit, period in (("DAY", lambda t: datetime(t.year, t.month, t.day)), ("MONTH", lambda t: datetime(t.year, t.month, 1))):
        want = {}
        for t, agent in calls:
            if D[0] <= t < D[9] and agent is not None:
                want.setdefault(period(t), set()).add(agent)
        got = {r["period"]: r["people"] for r in store.people_by_period("calls", D[0], D[9], unit).collect()}
        assert {k: v for k, v in got.items() if v} == {k: len(v) for k, v in want.items()}


def test_sets_are_exact_for_any_id(spark, tmp_path):
    """Ids of all sizes and signs, missing ids, an hour of one agent."""
    ids = [None, 0, 1, -1, 32768, 32769, 65536, -32768, -32769, 10**15, 10**15 + 1, 2**62, 5, 5]
    calls = [
        dict(start_time=D[1] + timedelta(minutes=7 * i), agent_number=a, direction="INBOUND" if i % 2 else None, duration_talk=30 * i)
        for i, a in enumerate(ids * 6)
    ]
    calls.append(dict(start_time=D[1] + timedelta(hours=23, minutes=59), agent_number=None, direction="X", duration_talk=None))
    t = make_tables(
        spark,
        phone_calls=calls,
        rotas=[
            dict(rslid=i, personid=p, role="Call Handler", truelogin=D[1] - timedelta(minutes=1 + i), truelogout=D[1] + timedelta(hours=3 + i))
            for i, p in enumerate([7, 7, None, -4, 10**12])
        ],
    )
    store = HourStore(spark, str(tmp_path / "h"), t, version="hand")
    store.fill(D[0], D[2])
    for report in ("call_stats_hourly", "calls_by_hour", "staff_per_hour", "hourly_activity"):
        assert rows(getattr(store, report)(D[0], D[2])) == rows(getattr(hourly, report)(t, D[0], D[2])), report


def test_what_is_not_stored_is_an_error(store):
    store.fill(D[1], D[2])
    with pytest.raises(LookupError):
        store.calls_by_hour(D[0], D[2])
    with pytest.raises(ValueError):
        store.fill(D[1] + timedelta(minutes=5), D[2])
    assert store.fill(D[2], D[1]) == []


def test_two_writers_of_a_day(spark, small_tables, tmp_path, monkeypatch):
    """Both store the same days; sums do not double."""
    a = HourStore(spark, str(tmp_path / "h"), small_tables)
    b = HourStore(spark, str(tmp_path / "h"), small_tables)
    monkeypatch.setattr(b, "days", lambda: {})  # looked before a had published
    a.fill(D[1], D[2])
    b.fill(D[1], D[2])
    assert rows(a.hourly_activity(D[1], D[2])) == rows(hourly.hourly_activity(small_tables, D[1], D[2]))
