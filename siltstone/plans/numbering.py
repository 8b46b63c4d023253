"""Dense numbers in an order, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import saved


def number_rows(df: DataFrame, order: list[str], name: str, start: int = 0, within: list[str] | None = None) -> DataFrame:
    """Adds a long that counts rows in an order from `start`, for each value of the columns `within` if they are given.

    Rows are dealt by ranges of (within, order), numbered inside each range, and moved on by what earlier ranges hold: a
    group of any size is spread over as many tasks as it fills. Ties get different numbers. The ranges are written to the
    shared folder, for a second run of a range sort may cut elsewhere.
    """
    keys = within or []
    ranged = df.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id())
    ranged = saved(ranged)
    same = [F.col(k) for k in keys]
    counts = ranged.groupBy("__p", *same).agg(F.count("*").alias("__n"))  # a row per range and group
    before = Window.partitionBy(*same).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    counts = counts.select(F.col("__p").alias("__q"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__before")
    on = F.col("__p") == F.col("__q")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    local = F.row_number().over(Window.partitionBy("__p", *same).orderBy(*order))
    out = ranged.withColumn("__i", local).join(counts, on)
    return out.withColumn(name, (F.col("__i") - 1 + F.col("__before") + start).cast("long")).select(*df.columns, name)
