"""Generated keys and name lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatwise.workspace import cut_lineage


def assign_ids(
    df: DataFrame,
    id_col: str,
    order_cols: list[str],
    existing: DataFrame | None = None,
    n_parts: int | None = None,
) -> DataFrame:
    """Number the rows 1, 2, 3.. in ``order_cols`` order, after the highest existing id.

    One range shuffle sorts the rows; ``monotonically_increasing_id`` then carries the
    task number and the position inside the task. Only the row count per task is summed
    up, so no task ever sees the whole table. The sorted rows are written out once:
    range bounds are sampled, and a recomputed task could number its rows differently.
    """
    args = [n_parts] if n_parts else []
    placed = cut_lineage(
        df.repartitionByRange(*args, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_task", F.shiftright("_pos", 33))
    )
    # One row per task of the shuffle above: the unpartitioned window stays small.
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_task").agg(F.count("*").alias("_n")).select(
        "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    base = F.lit(0).cast("long")
    if existing is not None:
        base = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()
    row = F.col("_pos") - F.shiftleft(F.col("_task"), 33)
    return placed.join(F.broadcast(offsets), "_task").select(
        *[c for c in df.columns if c != id_col],
        (base + F.col("_offset") + row + 1).alias(id_col),
    )


def resolve_names(
    df: DataFrame, name_col: str, dim: DataFrame, dim_name: str, dim_id: str
) -> tuple[DataFrame, DataFrame]:
    """Replace a name by its id. Returns (resolved, rejected).

    A name that is not in ``dim`` or that stands for several ids is rejected with a reason.
    ``dim`` is reduced to one row per name first, so the join never multiplies rows, and
    the optimizer broadcasts it only if its size is below the session's threshold.
    """
    names = dim.groupBy(F.col(dim_name).alias(name_col)).agg(
        F.min(dim_id).alias(dim_id), F.count("*").alias("_ids")
    )
    looked_up = df.join(names, name_col, "left")
    reason = F.when(F.col("_ids").isNull(), "unknown name").when(F.col("_ids") > 1, "ambiguous name")
    resolved = looked_up.filter(F.col("_ids") == 1).drop("_ids", name_col)
    rejected = looked_up.filter(F.col("_ids").isNull() | (F.col("_ids") > 1)).select(
        *df.columns, reason.alias("reason")
    )
    return resolved, rejected
