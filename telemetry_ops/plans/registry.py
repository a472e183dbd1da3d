"""Registry of named queries; each may carry the equivalent SQL for cross-checking."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from telemetry_ops.plans.tables import CTES, Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        if name in QUERIES:
            raise ValueError(f"Query registered twice: {name}")
        QUERIES[name] = Query(name, build, sql)
        return build

    return register


def full_sql(sql: str) -> str:
    """Prefix a statement with the common table expressions it mentions, directly or not."""
    needed: set[str] = set()

    def collect(text: str) -> None:
        for word in set(re.findall(r"[a-z_0-9]+", text)):
            if word in CTES and word not in needed:
                needed.add(word)
                collect(CTES[word])

    collect(sql)
    parts = [f"{name} AS ({body})" for name, body in CTES.items() if name in needed]
    own = sql.strip()
    if own.upper().startswith("WITH "):
        parts.append(own[5:].lstrip())
        return "WITH " + ",\n".join(parts) if len(parts) > 1 else own
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + own
