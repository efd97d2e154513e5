"""The catalogue of named queries and operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    sql: str | None
    about: str


_entries: dict[str, Entry] = {}


def _rounded(df: DataFrame, columns: tuple[str, ...], digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns}) if columns else df


def query(name: str, sql: str | None = None, rounded: tuple[str, ...] | str = (), digits: int = 6):
    """Registers a query under a name that is still free. ``rounded``: columns compared after rounding, in both engines."""
    rounded = tuple(rounded.split()) if isinstance(rounded, str) else rounded

    def register(f: Query) -> Query:
        if name in _entries:
            raise ValueError(f"{name} is registered already")
        text = sql
        if sql is not None and rounded:
            text = f"select * replace ({', '.join(f'round({c}, {digits}) + 0.0::double as {c}' for c in rounded)}) from ({sql}) as rounded_q"
        _entries[name] = Entry(name, lambda spark, sf_dir: _rounded(f(spark, sf_dir), rounded, digits), text, (f.__doc__ or name).strip().split("\n")[0])
        return f

    return register


def get(name: str) -> Entry:
    """The entry of this name."""
    if name not in _entries:
        raise KeyError(f"no query is named {name}; known: {', '.join(sorted(_entries))}")
    return _entries[name]


def entries() -> dict[str, Entry]:
    """All entries by name."""
    return dict(_entries)


def catalogue(spark: SparkSession) -> DataFrame:
    """(name, has_oracle, about) of all entries."""
    return spark.createDataFrame([(e.name, e.sql is not None, e.about) for e in _entries.values()], "name string, has_oracle boolean, about string")
