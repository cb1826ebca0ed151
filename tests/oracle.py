"""Compares a Spark result with the result of the check SQL, order aside."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) and math.copysign(1, value) > 0 else repr(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def kind(name: str) -> str:
    """Coarse type, common to both engines."""
    low = name.lower()
    for mark, coarse in (("timestamp", "ts"), ("date", "date"), ("varchar", "str"),
                         ("string", "str"), ("bool", "bool"), ("double", "float"),
                         ("float", "float"), ("decimal", "decimal"), ("hugeint", "huge"),
                         ("int", "int"), ("long", "int"), ("short", "int")):
        if mark in low:
            return coarse
    return low


def compare(df, sql: str, con) -> tuple[bool, str]:
    rel = con.sql(sql)
    names = sorted(rel.columns)
    if names != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {names}"
    ours = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    theirs = {c: kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    theirs_order = [rel.columns.index(n) for n in names]
    ours_order = [df.columns.index(n) for n in names]
    left = sorted((tuple(cell(r[i]) for i in ours_order) for r in df.collect()), key=repr)
    right = sorted((tuple(cell(r[i]) for i in theirs_order) for r in rel.fetchall()), key=repr)
    note = f"{len(left)} rows"
    if ours != theirs:
        return False, f"types {[(n, ours[n], theirs[n]) for n in names if ours[n] != theirs[n]]}"
    if len(left) != len(right):
        return False, f"{len(left)} rows against {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return False, f"{len(wrong)} of {note} differ, first {names}: {wrong[0]}"
    return True, note
