"""Ordered work inside groups of any size.

A plain window puts a whole group into one task. Here a group is cut into chunks along its order: the rows of a chunk
are windowed on their own, and only one summary row per chunk is windowed across the group. A group holding a third of
all rows is so spread over as many tasks as it has chunks, and the result equals the plain window's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Names = Sequence[str]


def with_neighbours(rows: DataFrame, keys: Names, chunk: Column, order: Names, carry: Names) -> DataFrame:
    """Adds position (1..n), group size, and the previous and next row's ``carry`` columns as structs.

    ``order`` must tell the rows of a group apart, and ``chunk`` must not decrease along it. Rows of a null key are a
    group too. Chunks are by value: where the numbers behind them are so sparse that each row is a chunk of its own, the
    summary of a group is as long as the group, and one task windows it.
    """
    cut = rows.withColumns({"_chunk": chunk, "_carry": F.struct(*carry)})
    summary = cut.groupBy(*keys, "_chunk").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min_by("_carry", F.struct(*order)).alias("_first"),
        F.max_by("_carry", F.struct(*order)).alias("_last"),
    )
    along = W.partitionBy(*keys).orderBy("_chunk")
    frame = summary.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        F.col("_chunk").alias("_of"),
        F.sum("_rows").over(along.rowsBetween(W.unboundedPreceding, -1)).alias("_offset"),
        F.sum("_rows").over(W.partitionBy(*keys)).alias("_size"),
        F.lag("_last").over(along).alias("_prev"),
        F.lead("_first").over(along).alias("_next"),
    )
    same = F.col("_chunk").eqNullSafe(F.col("_of"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        cut.join(frame, same)
        .withColumns(
            {
                "position": F.coalesce("_offset", F.lit(0)) + F.row_number().over(inside),
                "group_size": F.col("_size"),
                "previous": F.coalesce(F.lag("_carry").over(inside), F.col("_prev")),
                "next": F.coalesce(F.lead("_carry").over(inside), F.col("_next")),
            }
        )
        .select(*rows.columns, "position", "group_size", "previous", "next")
    )


def ordered_items(rows: DataFrame, keys: Names, position: Column, item: Column) -> DataFrame:
    """One row per group with its items in order: ``keys, items``. A group is what one page or record holds."""
    placed = F.struct(position.alias("pos"), item.alias("item"))
    return (
        rows.select(*keys, placed.alias("_it"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("_it")).alias("_items"))
        .select(*keys, F.transform("_items", lambda x: x["item"]).alias("items"))
    )
