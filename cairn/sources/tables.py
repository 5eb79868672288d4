"""Roles: the named input tables every job reads.

A job never names a file. It asks a :class:`Tables` for a role such as
``"sample_group"`` and gets a DataFrame. The same job therefore runs over
Parquet folders, a JDBC source, hand-made test frames or the sample binding in
:mod:`cairn.sources.binding`.

Optional ``*_flat`` roles hold leaf tables that already carry the keys of the
levels above them (the usual layout of a large columnar store). Where one is
present the fact builders read it in place of joining the normalised tables.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Provider = Callable[[], DataFrame]


class Tables:
    """Role name to DataFrame, built on first use."""

    def __init__(self, spark: SparkSession, providers: Mapping[str, Provider | DataFrame]):
        self.spark = spark
        self._providers = dict(providers)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, role: str) -> DataFrame:
        if role not in self._built:
            if role not in self._providers:
                raise KeyError(f"no table is bound to role {role!r}")
            source = self._providers[role]
            self._built[role] = source if isinstance(source, DataFrame) else source()
        return self._built[role]

    def __contains__(self, role: str) -> bool:
        return role in self._providers

    def roles(self) -> list[str]:
        return sorted(self._providers)

    def with_roles(self, **providers: Provider | DataFrame) -> Tables:
        """A copy with some roles bound differently."""
        return Tables(self.spark, {**self._providers, **providers})

    def without(self, *roles: str) -> Tables:
        return Tables(
            self.spark, {k: v for k, v in self._providers.items() if k not in roles}
        )

    def lookup(self, role: str, column: str, value: Any) -> DataFrame:
        """The rows of a table whose ``column`` equals ``value``."""
        if column not in self[role].columns:
            raise ValueError(f"{role} has no column {column!r}")
        return self[role].where(F.col(column) == F.lit(value))


def parquet_tables(spark: SparkSession, paths: Mapping[str, str]) -> Tables:
    """Bind each role to a Parquet path."""
    return Tables(
        spark, {role: (lambda p=path: spark.read.parquet(p)) for role, path in paths.items()}
    )


def jdbc_tables(
    spark: SparkSession,
    url: str,
    tables: Mapping[str, str],
    properties: Mapping[str, str] | None = None,
    split: Mapping[str, tuple[str, int, int, int]] | None = None,
) -> Tables:
    """Bind each role to a table of a relational database.

    ``split`` gives, per role, the numeric column, its bounds and the number of
    parallel readers; a role without one is read by a single task.
    """
    split = split or {}

    def reader(role: str, table: str) -> Provider:
        def read() -> DataFrame:
            source = spark.read.format("jdbc").option("url", url).option("dbtable", table)
            for key, value in (properties or {}).items():
                source = source.option(key, value)
            if role in split:
                column, low, high, parts = split[role]
                source = (
                    source.option("partitionColumn", column)
                    .option("lowerBound", low)
                    .option("upperBound", high)
                    .option("numPartitions", parts)
                )
            return source.load()

        return read

    return Tables(spark, {role: reader(role, table) for role, table in tables.items()})
