"""Tickets as a stream: hourly adherence, and ingest that a repeated file does not repeat.  Both go beyond the batch engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.temporal import with_until
from ..sources.tables import BUCKETS, inserted_into, upserted_into


def hourly_adherence(tickets: DataFrame, sla: DataFrame, late: str = "2 hours") -> DataFrame:
    """A stream of tickets (created_at timestamp) -> window start, tickets, on_time, once an hour can get no more tickets.

    The target in force on a ticket's day is joined from the static table, so late tickets are judged as of their day.  The
    table becomes a calendar, a row for each day up to its last entry, and that entry holds from then on: the stream meets it
    by the day and one row, however many entries there are.  Of entries of one day the largest target counts.
    """
    by_day = sla.where("effective_from IS NOT NULL").groupBy("effective_from").agg(F.max("target_seconds").alias("target_seconds"))
    days = with_until(by_day, "effective_from", []).where("until IS NOT NULL")
    days = days.select(F.explode(F.sequence("effective_from", F.date_sub("until", 1))).alias("day__"), "target_seconds")
    last = by_day.agg(F.max("effective_from").alias("since__"), F.max_by("target_seconds", "effective_from").alias("last__"))
    live = tickets.where("NOT recalled").withWatermark("created_at", late).withColumn("day__", F.to_date("created_at"))
    due = live.join(days, "day__", "left").crossJoin(F.broadcast(last))
    target = F.when(F.col("day__") >= F.col("since__"), F.col("last__")).otherwise(F.col("target_seconds"))
    ok = F.col("completion_seconds") <= F.coalesce(target, F.lit(300))
    per = due.groupBy(F.window("created_at", "1 hour")).agg(F.count(F.lit(1)).alias("tickets"), F.count_if(ok).alias("on_time"))
    return per.select(F.col("window.start").alias("hour_start"), "tickets", "on_time")


def once_each(tickets: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream without repeats of a row_hash within the watermark; ``ingested_once`` has no such limit."""
    return tickets.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["row_hash"])


def ingested_once(stream: DataFrame, table: str, keys: list[str], order: list[Column], checkpoint: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """A writer that adds to the table at ``table`` the rows of ``stream`` whose key it does not hold, however long ago that came.

    A micro-batch meets the keys of the buckets that it touches, and writes only what is new.  The commit that adds a
    batch also records its number, so a batch repeated after a crash, and a file that comes again, add nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        inserted_into(batch, table, keys, order, (checkpoint, number), buckets)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def upserted_batches(stream: DataFrame, table: str, keys: list[str], order: list[Column], checkpoint: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """A writer that upserts each micro-batch of ``stream`` into the table at ``table``: one row per key, the first in ``order``.

    A micro-batch reads and writes the buckets that its keys touch, and its number is part of the commit: run again after
    a failure it changes nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        upserted_into(batch, table, keys, order, (checkpoint, number), buckets)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def status_row(progress: list[dict], at: str, error: str | None = None) -> dict[str, object]:
    """What a sync's status row says of a streaming query's progress reports: when, whether it went well, rows read, last batch."""
    return {"attempted_at": at, "ok": error is None, "error": error or "", "rows": sum(p.get("numInputRows", 0) for p in progress), "last_batch": max((p["batchId"] for p in progress), default=-1)}
