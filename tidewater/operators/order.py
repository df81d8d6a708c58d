"""Rows beside a row in its key's order, without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def beside(df: DataFrame, key: str, order: list[str], value: Column, part: Column, name: str, after: bool = True) -> DataFrame:
    """Adds ``name``: a struct with ``v``, the value of the key's next row by ``order`` (with ``after`` false: of the one before); null where there is none.

    ``part`` grows with the order, as the day of a time does. A window sees the rows of one key and part only, so that a
    key with very many rows is spread over tasks; from part to part go only each part's end rows. Rows with a null key are strangers to other parts.
    """
    end, step = (F.min_by, F.lead) if after else (F.max_by, F.lag)
    rows = df.withColumn("_part", part).withColumn("_value", F.struct(value.alias("v")))
    ends = rows.groupBy(key, "_part").agg(end("_value", F.struct(*order)).alias("_end"))
    ends = ends.withColumn("_beyond", step("_end").over(Window.partitionBy(key).orderBy("_part"))).filter(F.col("_beyond").isNotNull()).select(F.col(key).alias("_k"), F.col("_part").alias("_p"), "_beyond")
    rows = rows.withColumn("_beside", step("_value").over(Window.partitionBy(key, "_part").orderBy(*order)))
    joined = rows.join(ends, (F.col(key) == F.col("_k")) & (F.col("_part") == F.col("_p")), "left")
    return joined.withColumn(name, F.coalesce("_beside", "_beyond")).drop("_part", "_value", "_beside", "_beyond", "_k", "_p")
