"""Hourly demand, shift weights and slot costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOT_MINUTES = 5


def hourly_averages(tickets: DataFrame) -> DataFrame:
    """hour, average: tickets of an hour over the distinct days with any ticket; at most 24 rows."""
    live = tickets.where(~F.col("recalled"))
    per = live.groupBy(F.hour("created_at").alias("hour"), F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = per.agg(F.count_distinct("day").alias("days"))
    return per.groupBy("hour").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(days)).select("hour", (F.col("n") / F.col("days")).alias("average"))


def shift_weights(shifts: DataFrame, hourly: DataFrame) -> DataFrame:
    """shift_id, weight: expected tickets, half-even, at least 1; whole hours where there is no ticket history."""
    hours = shifts.select("shift_id", "start_min", "end_min", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    overlap = F.greatest(F.lit(0), F.least("end_min", (F.col("hour") + 1) * 60) - F.greatest("start_min", F.col("hour") * 60))
    joined = hours.join(F.broadcast(hourly), "hour", "left").groupBy("shift_id", "start_min", "end_min")
    sums = joined.agg(F.sum(F.coalesce("average", F.lit(0.0)) * overlap / 60).alias("x"), F.count("average").alias("known"))
    any_ = hourly.agg((F.count(F.lit(1)) > 0).alias("any"))
    weight = F.when(F.col("any"), F.bround("x")).otherwise(F.floor((F.col("end_min") - F.col("start_min")) / 60))
    return sums.crossJoin(F.broadcast(any_)).select("shift_id", F.greatest(F.lit(1), weight.cast("int")).alias("weight"))


def slot_costs(hourly: DataFrame) -> DataFrame:
    """slot, cost of the 288 five-minute slots of a day."""
    slots = hourly.sparkSession.range(1440 // SLOT_MINUTES).select(F.col("id").cast("int").alias("slot"), F.floor(F.col("id") * SLOT_MINUTES / 60).cast("int").alias("hour"))
    return slots.join(F.broadcast(hourly), "hour", "left").select("slot", F.bround(F.coalesce("average", F.lit(0.0)) * 10).cast("int").alias("cost"))
