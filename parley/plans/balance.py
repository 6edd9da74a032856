"""Partitions of about equal cost, for work whose time has little to do with its bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash slots a partition; so finely is cost dealt.
SLOTS = 64


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over all shuffle partitions, which adaptive execution then leaves as they are.

    Scoring takes much time for few bytes, so partitions that are joined for their size would leave cores idle.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def balanced(rows: DataFrame, cost: str, by: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` dealt over ``parts`` partitions of about the same total ``cost``, the costliest first within each.

    Rows fall into slots by a hash of ``by``; the slots' costs, ``SLOTS`` numbers a partition whatever the table, are
    summed up in order and cut into equal shares. A null or negative cost counts as none, and every row counts a little,
    so rows without cost spread as well. No partition holds more than its share and one slot. ``rows`` is read twice.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.pmod(F.xxhash64(*by), F.lit(parts * SLOTS)).cast("int")
    own = F.greatest(F.coalesce(F.col(cost).cast("double"), F.lit(0.0)), F.lit(0.0))
    sums = rows.groupBy(slot.alias("__slot")).agg(F.sum(own).alias("__c"), F.count("*").alias("__k"))
    every = Window.partitionBy()
    weight = F.col("__c") / F.greatest(F.sum("__c").over(every), F.lit(1e-9)) + F.col("__k") / F.sum("__k").over(every) * 0.01
    sums = sums.withColumn("__w", weight)
    upto = F.sum("__w").over(Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__w") / 2
    cut: Column = F.least(F.floor(upto / F.sum("__w").over(every) * parts), F.lit(parts - 1)).cast("int")
    table = sums.select("__slot", cut.alias("__part"))
    dealt = rows.withColumn("__slot", slot).join(F.broadcast(table), "__slot")
    order = [F.col(cost).desc_nulls_last(), *by]
    return dealt.repartitionById(parts, F.col("__part")).sortWithinPartitions(*order).drop("__slot", "__part")
