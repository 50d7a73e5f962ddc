"""Temporal list join: captures against the list entries of their time.

A dated list entry says that from a moment on a key (a host, with all below it,
or a host and path prefix) is blocked, allowed, or no longer listed. The
entries of a key become validity intervals, each up to the next entry of the
key. A capture has one key for its host, each parent host and each path
prefix (an address in numbers has no parents); an as-of join evaluates it
against the intervals that hold at its fetch time. The most specific listed key
decides: a longer path before a shorter one, a path before a host, a longer host
before its parents.

Entries of a key at the same moment count as one (a block wins over an
allowance, and both over a removal). The intervals of a key do not overlap, so a capture's key meets
one at most and the join adds no rows. So that a key with many intervals and many captures
is not compared pair by pair, an interval is joined twice: by key for the whole
days it covers, of which a key has as many as the calendar has days, and by key
and day for the days that it begins or ends on. A host that a third of all captures
share is split by the skew join. Captures of the same URL and moment are
evaluated once. Path prefixes are made only to the depth of the deepest entry.

Captures without a URL, host or fetch time meet no entry and are not blocked.
Entries without key, action or time are void. An entry's time is its column
``at``, or else midnight of its ``day``. Repeated rows and null ids each
get their row. Empty tables give an empty result, or captures that are all
allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftwise.llm.common import field

#: fixed values: what an entry does from its moment on
BLOCK, ALLOW, REMOVE = "block", "allow", "remove"


def intervals(entries: DataFrame) -> DataFrame:
    """entries (key, action, at or day) -> (key, action, valid_from, valid_to), with
    an open end (null) for the last; removals close an interval."""
    strength = F.when(F.col("action") == BLOCK, 2).when(F.col("action") == ALLOW, 1).otherwise(0)
    moment = F.coalesce(field(entries, "at", "timestamp"), field(entries, "day", "timestamp"))
    moments = (
        entries.select(field(entries, "key", "string"), field(entries, "action", "string"), moment.alias("at"))
        .filter(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("action").isin(BLOCK, ALLOW, REMOVE))
        .groupBy("key", "at")
        .agg(F.max(strength).alias("strength"))
    )
    per_key = Window.partitionBy("key").orderBy("at")
    # an entry that repeats the state before it opens no new interval
    changes = moments.withColumn("was", F.lag("strength").over(per_key)).filter(~F.col("strength").eqNullSafe(F.col("was")))
    return (
        changes.withColumn("valid_to", F.lead("at").over(per_key))
        .filter(F.col("strength") > 0)
        .select(
            "key",
            F.when(F.col("strength") == 2, BLOCK).otherwise(ALLOW).alias("action"),
            F.col("at").alias("valid_from"),
            "valid_to",
        )
    )


def _active(keys: DataFrame, valid: DataFrame) -> DataFrame:
    """keys (url, at, c_key, rank) with the interval that holds at their moment."""
    first, last = F.to_date("valid_from"), F.to_date("valid_to")
    # the days it begins and ends on
    edges = valid.withColumn("edge", F.explode(F.array_distinct(F.array(first, F.coalesce(last, first)))))
    same = (F.col("c_key") == F.col("key")) & (F.to_date("at") == F.col("edge"))
    inside = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    # the days between
    whole = valid.filter(F.col("valid_to").isNull() | (F.datediff(last, first) > 1))
    between = (F.col("c_key") == F.col("key")) & (F.to_date("at") > first) & (last.isNull() | (F.to_date("at") < last))
    return keys.join(edges, same & inside).drop("edge").unionByName(keys.join(whole, between))


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """The path without its leading and trailing slashes, query and fragment."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/+([^?#]*)", 1)
    return F.regexp_replace(path, r"/+$", "")


def url_keys(url: Column, depth: int) -> Column:
    """(key, rank) of the host, its parents and its path prefixes of up to
    ``depth`` steps; a higher rank is more specific."""
    host, path = host_of(url), path_of(url)
    labels, steps = F.split(host, r"\."), F.split(path, "/+", depth + 1)
    # an address in numbers is one label: what follows its dots is no parent of it
    number = host.rlike(r"^[0-9]+(\.[0-9]+){3}$") | host.startswith("[")
    labels = F.when(number, F.array(host)).otherwise(labels)
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(
            F.array_join(F.slice(labels, F.size(labels) - i + 1, i), ".").alias("key"), i.cast("int").alias("rank")
        ),
    )
    none = F.array().cast("array<struct<key: string, rank: int>>")
    if depth:
        paths = F.transform(
            F.sequence(F.lit(1), F.least(F.size(steps), F.lit(depth))),
            lambda i: F.struct(
                F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")).alias("key"),
                (i + F.lit(1000)).cast("int").alias("rank"),  # a host has far fewer labels
            ),
        )
        hosts = F.concat(hosts, F.when(F.coalesce(path, F.lit("")) == "", none).otherwise(paths))
    return F.when(host.isNull(), none).otherwise(hosts)


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (id, url, fetched) -> id, fetched, blocked, n_active (entries
    active for its keys), entry_key and valid_from of the entry that decides."""
    rows = captures.select(
        field(captures, "id", "long"), field(captures, "url", "string"), field(captures, "fetched", "timestamp")
    )
    valid = intervals(entries)
    depth = valid.agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    keys = (
        rows.dropna(subset=["url", "fetched"])
        .select("url", F.col("fetched").alias("at"))
        .distinct()
        .select("url", "at", F.explode(url_keys(F.col("url"), depth)).alias("k"))
        .select("url", "at", F.col("k.key").alias("c_key"), F.col("k.rank").alias("rank"))
    )
    active = _active(keys, valid)
    best = active.groupBy(F.col("url").alias("b_url"), F.col("at").alias("b_at")).agg(
        F.count(F.lit(1)).alias("n_active"),
        F.max(F.struct("rank", (F.col("action") == BLOCK).alias("block"), "key", "valid_from")).alias("best"),
    )
    return rows.join(
        best, (F.col("url") == F.col("b_url")) & (F.col("fetched") == F.col("b_at")), "left"
    ).select(
        "id",
        "fetched",
        F.coalesce(F.col("best.block"), F.lit(False)).alias("blocked"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("best.key").alias("entry_key"),
        F.col("best.valid_from").alias("valid_from"),
    )


def reported(pages: DataFrame, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Captures and dated entries that the page table itself gives.

    A page is fetched on the day of 2024 that its id falls on in turn. A page
    full of stray symbols has its host blocked from that day on and taken off
    the list ``days`` days later; a page with a fragment in its URL has its
    first path step allowed from its day on.
    """
    url = F.col("url")
    rows = pages.select(
        field(pages, "page_id", "long").alias("id"),
        field(pages, "url", "string"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(field(pages, "page_id", "long"), F.lit(366)).cast("int")).alias("day"),
        field(pages, "html", "string").contains("%%%").alias("stray"),
    )
    host, step = host_of(url), F.split(path_of(url), "/+")[0]
    blocks = rows.filter("stray").select(
        host.alias("key"),
        F.explode(
            F.array(
                F.struct(F.lit(BLOCK).alias("action"), F.col("day")),
                F.struct(F.lit(REMOVE).alias("action"), F.date_add("day", days).alias("day")),
            )
        ).alias("e"),
    ).select("key", "e.action", "e.day")
    allows = rows.filter(url.contains("#") & (F.length(step) > 0)).select(
        F.concat(host, F.lit("/"), step).alias("key"), F.lit(ALLOW).alias("action"), "day"
    )
    captures = rows.select("id", "url", F.col("day").cast("timestamp").alias("fetched"))
    return captures, blocks.union(allows)
