"""A refresh from several sources, each of which may fail without harm to the others."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import upserted
from .shared import kept


@dataclass
class Source:
    name: str
    read: Callable[[], DataFrame]
    keys: list[str]
    order: list[Column]  # latest first


def load_config(path: str) -> dict:
    """The scrape configuration: a JSON object of page addresses and wanted columns, read on the driver."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    if not isinstance(config, dict):
        raise ValueError(f"{path}: no JSON object")
    return config


def refreshed(spark: SparkSession, tables: dict[str, DataFrame], sources: list[Source], at: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after the refresh, and a status row: attempted at, ok, rows by source, errors joined by semicolons.

    A source is read once, into the shared folder, and counted before anything of it is used; one that fails leaves its table as it was, and what
    the others brought is kept.
    """
    after, rows, errors = dict(tables), [], []
    for s in sources:
        try:
            new = kept(s.read(), "synced")  # what is counted is what is used
            n = new.count()
        except Exception as e:  # whatever a source throws is its status, not ours
            errors.append(f"{s.name}: {str(e).splitlines()[0][:200]}")
            rows.append((s.name, 0))
            continue
        after[s.name] = upserted(tables[s.name], new, s.keys, s.order)
        rows.append((s.name, n))
    status = spark.createDataFrame([(at, not errors, "; ".join(errors))], "attempted_at string, ok boolean, error string")
    counts = spark.createDataFrame(rows, "source string, rows long").agg(F.map_from_entries(F.collect_list(F.struct("source", "rows"))).alias("rows"))
    return after, status.crossJoin(counts)
