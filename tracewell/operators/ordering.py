"""Ranks and running sums over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.scratch import cut


def with_running(
    df: DataFrame, order: list[Column], rank: str = "rank", sums: dict[str, str] | None = None
) -> DataFrame:
    """``df`` with its row number under ``order``, and running sums that include the row.

    Rows are dealt by ranges of ``order``; each range counts for itself, and the totals
    of the ranges before it are added. Those totals are one row a partition. Rows
    that tie in ``order`` may come in either order, so add a tie-break where that matters.
    The dealt table is written to the shared folder, so ranges can't change between
    the two uses.
    """
    sums = sums or {}
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    total = dealt.groupBy("_part").agg(
        F.count("*").alias("_rows"), *[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()]
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"),
        *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_t_{name}") for name in sums],
    )
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn(rank, F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long"))
    out = out.withColumns({name: F.coalesce(F.sum(c).over(own), F.lit(0)) for name, c in sums.items()})
    out = out.join(F.broadcast(total), "_part")  # one row a partition
    out = out.withColumns({rank: F.col(rank) + F.col("_rows")} | {n: F.col(n) + F.col(f"_t_{n}") for n in sums})
    return out.drop("_part", "_rows", *[f"_t_{name}" for name in sums])
