"""Partition folders of tables written by path: listed, marked and swapped by name.

Everything here asks the file system for names; no data file is opened. A folder that begins
with an underscore is read by nobody: Spark's readers pass it over.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession


def folder_of(path: str, slot: Mapping[str, object]) -> str:
    """The folder of one partition."""
    return "/".join([path.rstrip("/"), *(f"{k}={v}" for k, v in slot.items())])


def _place(spark: SparkSession, folder: str):
    """Hadoop's path of a folder and the file system that holds it."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(folder)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def has_slot(spark: SparkSession, path: str, **slot: object) -> bool:
    """Whether the partition is there, with or without rows."""
    place, files = _place(spark, folder_of(path, slot))
    return bool(files.exists(place))


def mark_slot(spark: SparkSession, path: str, **slot: object) -> None:
    """Makes a partition without rows, for input that is complete and empty."""
    place, files = _place(spark, folder_of(path, slot))
    files.mkdirs(place)


def listed_slots(spark: SparkSession, path: str, columns: Sequence[str]) -> list[dict[str, str]]:
    """Values of the leading partition columns of every partition folder.

    One listing per level. What comes back is one name per partition, e.g. per day.
    """
    place, files = _place(spark, folder_of(path, dict.fromkeys(columns, "*")))
    found = files.globStatus(place) or []
    slots = []
    for status in found:
        parts = status.getPath().toString().rsplit("/", len(columns))[-len(columns):]
        slots.append(dict(part.split("=", 1) for part in parts))
    return slots


def drop_slot(spark: SparkSession, path: str, **slot: object) -> bool:
    """Removes a partition with all below it."""
    place, files = _place(spark, folder_of(path, slot))
    return bool(files.delete(place, True))


def swap_in(spark: SparkSession, staged: str, path: str, **slot: object) -> None:
    """Puts a folder written aside in the place of a partition.

    Readers that list the table see the old partition or the new one, but for the moment
    between two renames; a job that dies before leaves the old one as it was. If the new one
    cannot be put in place, the old one comes back.
    """
    target, files = _place(spark, folder_of(path, slot))
    aside, _ = _place(spark, f"{path.rstrip('/')}/_replaced-{uuid.uuid4().hex}")
    source, _ = _place(spark, staged)
    if not files.exists(source):
        raise OSError(f"{staged} is not there")
    files.mkdirs(target.getParent())
    replaced = files.exists(target)
    if replaced and not files.rename(target, aside):
        raise OSError(f"cannot move {target.toString()}")
    placed = False
    try:
        placed = files.rename(source, target)
    finally:
        if replaced and not placed:
            files.rename(aside, target)
    if not placed:
        raise OSError(f"cannot put {staged} in place")
    if replaced:
        files.delete(aside, True)
