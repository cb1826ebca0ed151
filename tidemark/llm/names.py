"""Names for helper columns that no given column has."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame


def spare(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores put before it until it is free.

    Spark compares names without regard to case, so this does too.
    """
    held, found = {name.lower() for name in taken}, []
    for name in wanted:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        found.append(name)
    return found


def apart(*inner: str) -> Callable:
    """Lets an operator take tables with columns named as its own helper columns.

    Such columns go by other names inside and come back under their own.
    """
    held = {name.lower() for name in inner}

    def wrap(operator: Callable) -> Callable:
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            clashing = [c for c in docs.columns if c.lower() in held]
            if not clashing:
                return operator(docs, *args, **options)
            away = spare([*docs.columns, *inner], *(f"given{c}" for c in clashing))
            inside = dict(zip(clashing, away, strict=True))

            def moved(value):
                return inside.get(value, value) if isinstance(value, str) else value

            out = operator(docs.withColumnsRenamed(inside), *map(moved, args),
                           **{k: moved(v) for k, v in options.items()})
            return out.withColumnsRenamed(dict(zip(away, clashing, strict=True)))
        return run
    return wrap
