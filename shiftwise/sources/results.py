"""Stored report results, by report, arguments and input version, for an hour.

The first call of a report with some arguments writes its result as Parquet and
publishes a manifest; a later call with the same arguments reads the stored rows,
until they expire or the input changes. Callers that ask at the same time
may both compute: each writes into its own folder and publishes it whole, and
readers take the newest. ``sweep`` removes what expired long enough ago that nobody
reads it any more.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from shiftwise.functions.exprs import as_datetime
from shiftwise.sources import manifests
from shiftwise.sources.tables import Tables

#: Fixed value: how long a stored result may be read.
EXPIRY = timedelta(hours=1)


def _plain(value):
    """An argument as JSON; a date is its midnight, so both name one result."""
    if isinstance(value, (date, datetime)):
        return {"time": as_datetime(value).isoformat()}
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    raise TypeError(f"an argument of type {type(value).__name__} cannot name a result")


class ResultStore:
    """Results below ``root``; ``clock`` gives seconds since 1970."""

    def __init__(
        self, spark: SparkSession, root: str, expiry: timedelta = EXPIRY, clock: Callable[[], float] = time.time
    ) -> None:
        self.spark, self.root, self.expiry, self.clock = spark, root.rstrip("/"), expiry.total_seconds(), clock

    def _folder(self, report: str, args: dict) -> tuple[str, str]:
        named = json.dumps({"report": report, "args": {k: _plain(v) for k, v in args.items()}}, sort_keys=True)
        return f"{self.root}/{hashlib.sha256(named.encode()).hexdigest()}", named

    def _valid(self, manifest: dict, version: str) -> bool:
        age = self.clock() - manifest["created"]
        return manifest["version"] == version and 0 <= age < self.expiry

    def get(self, report: str, args: dict, version: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """The stored result of ``report`` with ``args`` over the input ``version``,
        or that of ``compute()``, stored now."""
        folder, named = self._folder(report, args)
        for found in manifests.published(self.spark, folder):
            if self._valid(found, version):
                return self._read(folder, found)
        df = compute()
        content = {"named": named, "version": version, "data": f"data-{uuid.uuid4().hex}", "schema": df.schema.json()}
        df.write.parquet(f"{folder}/{content['data']}")
        content["created"] = self.clock()
        manifests.publish(self.spark, folder, content)
        return self._read(folder, content)

    def _read(self, folder: str, manifest: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        return self.spark.read.schema(schema).parquet(f"{folder}/{manifest['data']}")

    def report(self, run: Callable[..., DataFrame], tables: Tables, version: str | None = None, **args) -> DataFrame:
        """``run(tables, **args)``, stored under the function's name. The input
        version is that of the tables' files unless the caller names it."""
        version = version or manifests.files_version(*tables.as_dict().values())
        return self.get(f"{run.__module__}.{run.__name__}", args, version, lambda: run(tables, **args))

    def sweep(self, grace: timedelta = EXPIRY) -> int:
        """Removes results that expired more than ``grace`` ago, and data of
        writers that never published; how many folders went."""
        gone, old = 0, self.clock() - self.expiry - grace.total_seconds()
        for key, _ in manifests.folders(self.spark, self.root, ""):
            folder, kept = f"{self.root}/{key}", set()
            for found in manifests.published(self.spark, folder):
                if found["created"] < old:
                    manifests.remove(self.spark, folder, found["name"])
                else:
                    kept.add(found["data"])
            for name, changed in manifests.folders(self.spark, folder, "data-"):
                if name not in kept and changed < old:
                    manifests.remove(self.spark, folder, name)
                    gone += 1
        return gone
