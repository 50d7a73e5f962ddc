import datetime as dt
import re
from collections import Counter

from pyspark.sql import functions as F

from shiftwise.llm import url_lists as U
from tests.llm.conftest import SMALL

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def keys_of(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)(/[^?#]*)?", url or "")
    host = re.sub(r":[0-9]*$", "", re.sub(r"^.*@", "", m[1])).lower().rstrip(".") if m else ""
    if not host:
        return []
    number = re.fullmatch(r"[0-9]+(\.[0-9]+){3}", host) or host.startswith("[")
    labels, path = [host] if number else host.split("."), (m[2] or "").strip("/")
    steps = re.split("/+", path) if path else []
    out = [(i, ".".join(labels[-i:])) for i in range(1, len(labels) + 1)]
    return out + [(1000 + i, host + "/" + "/".join(steps[:i])) for i in range(1, len(steps) + 1)]


def slow(captures, entries):
    strength = {"block": 2, "allow": 1, "remove": 0}
    state = {}
    for key, action, at in entries:
        if key is not None and at is not None and action in strength:
            days = state.setdefault(key, {})
            days[at] = max(days.get(at, 0), strength[action])
    out = Counter()
    for i, url, at in captures:
        active = []
        for rank, key in keys_of(url) if at else []:
            past = [d for d in state.get(key, ()) if d <= at]
            if past and state[key][max(past)]:
                run = sorted(past, reverse=True)
                since = run[0]
                for d in run[1:]:  # back to where this state began
                    if state[key][d] != state[key][run[0]]:
                        break
                    since = d
                active.append((rank, state[key][max(past)] == 2, key, since))
        best = max(active, default=(None, False, None, None))
        out[(i, at, best[1], len(active), best[2], best[3])] += 1
    return out


URLS = [
    "http://a.example.com/x/y?q=1", "https://user@b.example.com:8080//x//y/", "http://example.com", "HTTP://EXAMPLE.COM./x#f",
    "ftp://other.org/p/q/r", "not a url", "", None, "http:///nohost", "http://a.example.com/x", "http://x.org/" + "s/" * 3000,
]
ENTRIES = [
    ("example.com", "block", day(3)), ("example.com", "remove", day(9)), ("example.com", "remove", day(5)), ("example.com", "block", day(5)),
    ("a.example.com", "allow", day(4)), ("a.example.com/x", "block", day(6)), ("a.example.com/x", "block", day(7)), ("a.example.com/x/y", "allow", day(8)),
    ("com", "block", day(1)), ("com", "remove", day(2)), (None, "block", day(1)), ("other.org", "what", day(1)), ("other.org", "block", None),
    ("x.org/s/s", "block", day(0)), ("b.example.com/x/y", "block", day(0)),
]


def rows(got):
    return Counter((r.id, r.fetched and r.fetched.date(), r.blocked, r.n_active, r.entry_key, r.valid_from and r.valid_from.date()) for r in got)


def test_every_capture_meets_the_entries_of_its_day(spark):
    captures = [(i % 7 or None, u, day(n) if n else None) for n in range(12) for i, u in enumerate(URLS)] * 2
    df = spark.createDataFrame(captures, "id long, url string, fetched date").withColumn("key", F.lit("clash"))
    entries = spark.createDataFrame(ENTRIES, "key string, action string, day date")
    assert rows(U.evaluate(df, entries).collect()) == slow(captures, ENTRIES)
    none = U.evaluate(df, entries.limit(0)).collect()
    assert len(none) == len(captures) and not any(r.blocked or r.n_active for r in none)
    assert U.evaluate(df.limit(0), entries).collect() == []


def test_intervals_do_not_overlap(spark):
    got = U.intervals(spark.createDataFrame(ENTRIES, "key string, action string, day date")).collect()
    at = lambda n: dt.datetime.combine(day(n), dt.time())
    assert ("example.com", "block", at(3), at(9)) in {tuple(r) for r in got}
    assert ("a.example.com/x", "block", at(6), None) in {tuple(r) for r in got}


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    captures, entries = U.reported(pages)
    c = [(r.id, r.url, r.fetched.date()) for r in captures.collect()]
    e = [tuple(r) for r in entries.collect()]
    got = rows(U.evaluate(captures, entries).collect())
    assert got == slow(c, e) and any(k[3] for k in got)


def test_entries_and_captures_within_a_day(spark):
    """Blocked at 15:00 and off the list at 18:00: only what was fetched between."""
    noon = dt.datetime(2024, 1, 5, 12)
    hour = dt.timedelta(hours=1)
    entries = [
        ("x.org", "block", noon + 3 * hour), ("x.org", "remove", noon + 6 * hour), ("x.org", "block", noon + 40 * hour),
        ("x.org", "allow", noon + 200 * hour), ("y.org/a", "block", noon), ("y.org/a", "allow", noon), ("y.org", "allow", noon + 11 * hour),
    ]
    captures = [(i, u, noon + n * hour) for n in range(-24, 300, 3) for i, u in enumerate(["http://x.org/p", "http://a.y.org/a/b", "http://y.org/a/b"])]
    df = spark.createDataFrame(captures, "id long, url string, fetched timestamp")
    got = Counter((r.id, r.fetched, r.blocked, r.n_active, r.entry_key, r.valid_from) for r in U.evaluate(df, spark.createDataFrame(entries, "key string, action string, at timestamp")).collect())
    assert got == slow(captures, entries)
    blocked = {k[1] for k in got if k[0] == 0 and k[2]}
    assert noon not in blocked and noon + 3 * hour in blocked and noon + 6 * hour not in blocked and noon + 9 * hour not in blocked
    assert noon + 72 * hour in blocked and noon + 201 * hour not in blocked


def test_addresses_in_numbers_have_no_parents(spark):
    entries = [("0.1", "block", day(1)), ("1", "block", day(1)), ("10.0.0.1", "allow", day(1)), ("[::1]", "block", day(1)), ("10.0.0.2/x", "block", day(1))]
    urls = ["http://10.0.0.1/x", "http://10.0.0.2/x", "http://10.0.0.3/", "http://[::1]:80/", "http://a.0.1/", "http://1/", "http://[2001:db8::1]/"]
    captures = [(i, u, day(2)) for i, u in enumerate(urls)]
    got = U.evaluate(spark.createDataFrame(captures, "id long, url string, fetched date"), spark.createDataFrame(entries, "key string, action string, day date")).collect()
    assert rows(got) == slow(captures, entries)
    assert {r.id: (r.blocked, r.entry_key) for r in got if r.entry_key} == {
        0: (False, "10.0.0.1"), 1: (True, "10.0.0.2/x"), 3: (True, "[::1]"), 4: (True, "0.1"), 5: (True, "1"),
    }
