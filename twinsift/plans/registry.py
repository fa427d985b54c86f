"""The query registry and table access."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SECTIONS = ("scalars", "filters", "mining", "similarity", "evidence", "geo", "ranges",
            "dialogues", "reports", "files", "geoeval")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    section: str


REGISTRY: dict[str, Query] = {}


class Tables:
    """Parquet tables of one folder as attributes: `Tables(spark, folder).orders`.

    Each table is opened once; `once` keeps what several parts of a plan share.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.kept: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.once(name, lambda: self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]


def query(name: str, sql: str | None = None):
    """Register a plan taking the tables; `sql` states its result over the same tables."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(lambda spark, folder: fn(Tables(spark, folder)), sql,
                               fn.__module__.rsplit(".", 1)[-1])
        return fn
    return wrap


def load_all() -> dict[str, Query]:
    for section in SECTIONS:
        importlib.import_module(f"twinsift.plans.{section}")
    return REGISTRY
