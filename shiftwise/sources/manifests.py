"""Small JSON manifests that publish written tables atomically.

A writer puts its data into a folder of its own and then names a manifest by one
rename, onto a name that nobody else uses: readers see all of it or none, and two
writers never mix their files. Every file goes through Hadoop's file system, so
any store that Spark reads will do.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "manifest-"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def publish(spark: SparkSession, folder: str, content: dict) -> str:
    """Publish ``content`` (with its ``created`` seconds) below ``folder``; its name."""
    fs, path = _files(spark, folder)
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    name = f"{_PREFIX}{int(content['created'] * 1000):015d}-{uuid.uuid4().hex}.json"
    draft = new_path(path, f".{name}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()
    if not fs.rename(draft, new_path(path, name)):
        raise OSError(f"could not publish {name} in {folder}")
    return name


def published(spark: SparkSession, folder: str) -> list[dict]:
    """All manifests below ``folder``, newest first, each with its ``name``."""
    fs, path = _files(spark, folder)
    if not fs.exists(path):
        return []
    names = sorted((s.getPath().getName() for s in fs.listStatus(path)), reverse=True)
    found = []
    for name in names:
        if name.startswith(_PREFIX):
            stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(path, name))
            try:
                text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            found.append(json.loads(text) | {"name": name})
    return found


def remove(spark: SparkSession, folder: str, name: str) -> None:
    """Remove a file or folder below ``folder``."""
    fs, path = _files(spark, folder)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, name), True)


def folders(spark: SparkSession, folder: str, prefix: str) -> list[tuple[str, float]]:
    """Names and change times (seconds) of the folders below ``folder``."""
    fs, path = _files(spark, folder)
    if not fs.exists(path):
        return []
    found = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(path)]
    return sorted(f for f in found if f[0].startswith(prefix))


def files_version(*frames: DataFrame) -> str:
    """A digest of the names, lengths and change times of all files that
    ``frames`` read; it changes when a file is added, removed or rewritten."""
    spark = frames[0].sparkSession
    listed = sorted({f for df in frames for f in df.inputFiles()})
    if not listed:
        raise ValueError("the tables come from no files; name their version")
    digest = hashlib.sha256()
    for f in listed:
        fs, path = _files(spark, f)
        status = fs.getFileStatus(path)
        digest.update(f"{f}\0{status.getLen()}\0{status.getModificationTime()}\n".encode())
    return digest.hexdigest()
