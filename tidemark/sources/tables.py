"""Delimited text, imports from a database, and published tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import requests as rq
from tidemark.sources import slots

SIMILARITY_SCHEMA = "page_id BIGINT, link_id BIGINT, score DOUBLE"
EDGE_SCHEMA = "page_id BIGINT, link_id BIGINT"
# Missing values are written as \N. What could be taken for something else inside a text is
# written as a backslash and a letter, the empty text too, so that every text comes back.
MISSING = "\\N"
ESCAPES = (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0"))
EMPTY, SEPARATOR = "\\e", "\\s"
CLICK_SCHEMA = "prev_id BIGINT, curr_id BIGINT, n BIGINT, prev_title STRING, curr_title STRING"


def _format(sep: str, header: bool) -> dict:
    return {"sep": sep, "header": header, "nullValue": MISSING, "emptyValue": "", "quote": "",
            "escape": "\0", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _texts(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]


def _escaped(name: str, sep: str) -> Column:
    out = F.replace(F.col(name), F.lit("\\"), F.lit("\\\\"))
    for plain, written in (*ESCAPES, (sep, SEPARATOR)):
        out = F.replace(out, F.lit(plain), F.lit(written))
    return F.when(F.col(name) == "", EMPTY).otherwise(out)


def _unescaped(name: str, sep: str) -> Column:
    def single(part: Column) -> Column:
        for plain, written in (*ESCAPES, (sep, SEPARATOR), ("", EMPTY)):
            part = F.replace(part, F.lit(written), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(F.col(name), r"\\\\", -1), single), "\\")


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType,
                   sep: str = "\t", header: bool = False) -> DataFrame:
    """Text rows with one separator, under an explicit schema."""
    df = spark.read.schema(schema).options(**_format(sep, header)).csv(path)
    return df.withColumns({c: _unescaped(c, sep).alias(c) for c in _texts(df.schema)})


def write_delimited(df: DataFrame, path: str, sep: str = "\t", header: bool = False) -> None:
    """Writes a directory of text parts, one per task; see the escapes above."""
    texts = {c: _escaped(c, sep) for c in _texts(df.schema)}
    df.withColumns(texts).write.mode("overwrite").options(**_format(sep, header)).csv(path)


def read_similarity(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Item pairs with scores as another job wrote them."""
    return read_delimited(spark, path, SIMILARITY_SCHEMA, sep)


def read_jdbc_partitioned(spark: SparkSession, url: str, query: str, split_column: str,
                          lower: int | None = None, upper: int | None = None,
                          partitions: int = 4,
                          properties: Mapping[str, str] | None = None) -> DataFrame:
    """Imports a query in parallel ranges of a numeric column.

    Bounds that are not given are asked from the database (one row). Rows outside
    the bounds still arrive, with the first or last range.
    """
    properties = dict(properties or {})
    if lower is None or upper is None:
        asked = spark.read.jdbc(
            url, f"(SELECT MIN({split_column}) AS lo, MAX({split_column}) AS hi "
                 f"FROM ({query}) bounded) bounds", properties=properties).first()
        lower = asked[0] if lower is None else lower
        upper = asked[1] if upper is None else upper
        if lower is None or upper is None:
            lower, upper = 0, 1
    return spark.read.jdbc(url, f"({query}) imported", column=split_column,
                           lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties)


def import_query(table: str, columns: Sequence[str], where: str | None = None) -> str:
    """Query that an import sends: columns by name."""
    return f"SELECT {', '.join(columns)} FROM {table}" + (f" WHERE {where}" if where else "")


def as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that arrive as bytes as the UTF-8 text they hold, uncut; others as they are."""
    binary = {f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)}
    return df.withColumns({c: rq.utf8_text(c) for c in columns if c in binary})


def import_pages(spark: SparkSession, url: str, **options) -> DataFrame:
    """The page table, split by page id."""
    columns = ["page_id", "page_namespace", "page_title", "page_counter", "page_is_redirect"]
    return as_text(read_jdbc_partitioned(spark, url, import_query("page", columns), "page_id",
                                         **options), ["page_title"])


def import_page_links(spark: SparkSession, url: str, **options) -> DataFrame:
    """The table of links between pages, split by the linking page."""
    columns = ["pl_from", "pl_namespace", "pl_title", "pl_from_namespace"]
    return as_text(read_jdbc_partitioned(spark, url, import_query("pagelinks", columns), "pl_from",
                                         **options), ["pl_title"])


def import_revisions(spark: SparkSession, url: str, above: int = 10000, below: int = 12000,
                     **options) -> DataFrame:
    """Edits of the users between two ids, split by page; see ``links.edited_pages``."""
    query = import_query("revision", ["rev_user", "rev_page"],
                         where=f"rev_user > {int(above)} AND rev_user < {int(below)}")
    return read_jdbc_partitioned(spark, url, query, "rev_page", **options)


def publish_partitions(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Overwrites the partitions that ``df`` holds and leaves all others alone.

    A rerun replaces its own partitions, but cannot empty one for which it has no rows:
    a job that owns its slot uses :func:`publish_partition`. Rebalancing keeps the number of files
    small and splits a partition that is much larger than the rest.
    """
    (df.hint("rebalance", *[F.col(c) for c in columns]).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy(*columns).parquet(path))


def publish_partition(df: DataFrame, path: str, **slot: int) -> None:
    """Publishes one partition, e.g. ``year=2024, month=1, day=9``.

    The slot is written aside and then swapped in, so readers have the old rows while the job
    runs, and keep them if it dies. A rerun without rows empties the slot.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    df.drop(*slot).hint("rebalance").write.parquet(staged)
    slots.swap_in(spark, staged, path, **slot)


def keep_recent(df: DataFrame, as_of: date, keep_days: int = 7) -> DataFrame:
    """Rows of the last ``keep_days`` days up to ``as_of``, by partition columns."""
    day = F.make_date("year", "month", "day")
    return df.where((day > F.date_sub(F.lit(as_of), keep_days)) & (day <= F.lit(as_of)))


def drop_expired(spark: SparkSession, table: str, as_of: date, keep_days: int = 7) -> int:
    """Drops every partition of a catalog table older than the limit.

    Works on partition names only. Returns the number of dropped partitions.
    """
    expired = []
    for row in spark.sql(f"SHOW PARTITIONS {table}").toLocalIterator():
        spec = dict(part.split("=", 1) for part in row[0].split("/"))
        day = date(int(spec["year"]), int(spec["month"]), int(spec["day"]))
        if (as_of - day).days >= keep_days:
            named = ", ".join(f"{k} = '{v}'" for k, v in spec.items())
            expired.append(f"PARTITION ({named})")
    for start in range(0, len(expired), 200):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {', '.join(expired[start:start + 200])}")
    return len(expired)


def drop_expired_slots(spark: SparkSession, path: str, as_of: date, keep_days: int = 7) -> int:
    """Removes the days of a published table (written by path) that are older than the limit.

    Only partition names are listed, so slots without rows go too. Returns the number of
    removed days.
    """
    expired = [slot for slot in slots.listed_slots(spark, path, ["year", "month", "day"])
               if (as_of - date(*(int(v) for v in slot.values()))).days >= keep_days]
    return sum(slots.drop_slot(spark, path, **slot) for slot in expired)


def newest_day(spark: SparkSession, path: str) -> date | None:
    """The last day that a published table has a partition of."""
    days = [date(*(int(v) for v in slot.values()))
            for slot in slots.listed_slots(spark, path, ["year", "month", "day"])]
    return max(days, default=None)
