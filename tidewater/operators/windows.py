"""Tumbling-window summaries, their bounds as text, and the keyed facts they sum (batch forms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import time_text
from tidewater.operators.logs import first_of_day


def tumble(df: DataFrame, ts: str, width: str, keys: list[str], **measures: Column) -> DataFrame:
    """stt, edt (bounds as text), keys and measures by tumbling window. Works on tables and, in append mode, on streams."""
    grouped = df.groupBy(F.window(ts, width).alias("_w"), *keys).agg(*[m.alias(n) for n, m in measures.items()])
    return grouped.select(time_text(F.col("_w.start")).alias("stt"), time_text(F.col("_w.end")).alias("edt"), *keys, *measures)


def returning_users(days: DataFrame, user: str, day: str, gap: int = 8) -> DataFrame:
    """user, day, uu (1) and back (1 if at least ``gap`` calendar days after the user's day before, else 0); ``days`` has a row for each user and day."""
    before = F.lag(day).over(Window.partitionBy(user).orderBy(day))
    return days.select(user, day, F.lit(1).alias("uu"), F.when(F.datediff(day, before) >= gap, 1).otherwise(0).alias("back"))


def order_users(orders: DataFrame, user: str, day: str, order: list[str]) -> DataFrame:
    """First order of each user and day, with first_ever 1 where it is the user's first day."""
    first = first_of_day(orders, [user], day, order)
    debut = orders.groupBy(user).agg(F.min(day).alias("_debut"))
    return first.join(debut, user).withColumn("first_ever", F.when(F.col(day) == F.col("_debut"), 1).otherwise(0)).drop("_debut")


def page_view_rows(pages: DataFrame, visitors: DataFrame, jumps: DataFrame, dims: list[str], ts: str, during: str, entry: str) -> DataFrame:
    """The three streams in one shape: dims, ts, uv_ct, sv_ct, pv_ct, dur_sum, uj_ct."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def shape(df: DataFrame, uv=zero, sv=zero, pv=zero, dur=F.lit(0.0), uj=zero) -> DataFrame:
        return df.select(*dims, ts, uv.alias("uv_ct"), sv.alias("sv_ct"), pv.alias("pv_ct"), dur.cast("double").alias("dur_sum"), uj.alias("uj_ct"))

    entered = F.when(F.col(entry), 1).otherwise(0).cast("long")
    return shape(pages, sv=entered, pv=one, dur=F.coalesce(F.col(during), F.lit(0))).unionByName(shape(visitors, uv=one)).unionByName(shape(jumps, uj=one))
