"""Small files in Spark's file systems, written once, under a name of their own.

A file appears with all of its text or not at all, and never replaces another.
That is all that is needed to publish what large writes have left elsewhere:
names carry a growing number, and the largest one counts.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path), the path in full."""
    plain = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = plain.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, plain.makeQualified(fs.getUri(), fs.getWorkingDirectory())


def full_path(spark: SparkSession, path: str) -> str:
    """The path with its file system, as every process resolves it."""
    return hadoop_path(spark, path)[1].toString()


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file below the shared folder, for a task."""
    local = uri.removeprefix("file:")
    if local.startswith("/"):
        return pafs.LocalFileSystem(), "/" + local.lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def copy_folder(spark: SparkSession, source: str, target: str) -> None:
    """Copies a folder with its files to a new path."""
    (fs, old), (other, new) = hadoop_path(spark, source), hadoop_path(spark, target)
    if other.exists(new):
        raise FileExistsError(target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, old, other, new, False, spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, path = hadoop_path(spark, folder)
    if not fs.exists(path):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(path))


def write_new(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Write a file, false if the name is taken already."""
    fs, parent = hadoop_path(spark, folder)
    fs.mkdirs(parent)
    path = spark._jvm.org.apache.hadoop.fs.Path
    target, part = path(parent, name), path(parent, f".{uuid.uuid4().hex}.part")
    stream = fs.create(part, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.exists(target) and fs.rename(part, target):
        return True
    fs.delete(part, False)
    return False


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, full = hadoop_path(spark, path)
    stream = fs.open(full)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if there is one."""
    fs, full = hadoop_path(spark, path)
    fs.delete(full, True)


def publish(spark: SparkSession, folder: str, key: str, text: str) -> int:
    """Write the next version of ``key``; the version's number."""
    number = newest(spark, folder).get(key, 0)
    while True:
        number += 1
        if write_new(spark, folder, f"{key}.{number:09d}.json", text):
            return number


def newest(spark: SparkSession, folder: str) -> dict[str, int]:
    """The number of the newest version of each key."""
    found: dict[str, int] = {}
    for name in names(spark, folder):
        key, _, rest = name.partition(".")
        number = rest.removesuffix(".json")
        if number.isdigit():
            found[key] = max(found.get(key, 0), int(number))
    return found


def version_path(folder: str, key: str, number: int) -> str:
    return f"{folder}/{key}.{number:09d}.json"
