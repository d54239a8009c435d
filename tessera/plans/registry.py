"""Queries as functions of a dialect, registered with the inventory ids that they cover."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .dialect import ANSI, SPARK, Dialect

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def tables_in(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql)]


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the Parquet tables in sf_dir; the tables are bound to this statement only."""
    used = tables_in(sql)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    safe = sql.replace("{", "{{").replace("}", "}}")
    bound = re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(used) + r")\b", r"\1 {\2}", safe) if used else safe
    return spark.sql(bound, **frames)


def query(name: str, covers: str):
    """Register build(dialect) -> SQL under a name; covers: the inventory ids."""

    def add(build: Callable[[Dialect], str]):
        QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, build(SPARK))
        ORACLES[name] = build(ANSI)
        COVERS[name] = covers
        return build

    return add


def frame(name: str, covers: str, oracle: Callable[[Dialect], str] | None = None):
    """Register a DataFrame function (spark, sf_dir), with or without SQL that gives the same rows."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        COVERS[name] = covers
        if oracle:
            ORACLES[name] = oracle(ANSI)
        return build

    return add
