"""Running totals over time that no single instant, bucket or key can overload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets of 2^25 microseconds, about 34 seconds, and runs of 2^12 of them, about 38 hours.
_BITS = 25
_RUN_BITS = 12

_FOLD = {"sum": F.sum, "max": F.max}


def _plus(kind: str, a: Column, b: Column) -> Column:
    if kind == "max":
        return F.greatest(a, b)
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def running(
    points: DataFrame, at: str, folds: dict[str, str], keys: Sequence[str] = ()
) -> DataFrame:
    """For each distinct (keys, at) and each column c of ``folds`` (name -> ``sum`` or
    ``max``): c folded over that instant, and ``c_before`` folded over everything earlier
    of the same key. ``at`` is in microseconds. Rows without key or instant are left out.
    The bucket ``_b`` stays in the result: a second pass over it then needs no new shuffle.

    Rows of one instant are folded first, with map-side combine. One window then runs
    inside each ~34 s bucket and one over the bucket totals of each key. However many
    rows share a key, a bucket or an instant, a window sees at most one row per
    microsecond of its bucket or one row per 34 seconds of the calendar. Without keys the
    bucket totals are folded in runs, and only run totals (a row per 38 hours) meet in one window.
    """
    keys = list(keys)

    def earlier(group: list[str], order: str) -> list[Column]:
        frame = (
            Window.partitionBy(*(group or [F.lit(0)]))
            .orderBy(order)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        return [_FOLD[kind](c).over(frame).alias(f"{c}_before") for c, kind in folds.items()]

    totals = [_FOLD[kind](c).alias(c) for c, kind in folds.items()]
    # The join below would add these NULL filters to one of its sides only; stated here,
    # both uses of ``instants`` keep the same plan and share one shuffle.
    known = points
    if "_b" not in points.columns:
        known = points.withColumn("_b", F.shiftright(at, _BITS))
    for c in [*keys, "_b"]:
        known = known.filter(F.col(c).isNotNull())
    instants = known.groupBy(*keys, "_b", at).agg(*totals)
    buckets = instants.groupBy(*keys, "_b").agg(*totals)
    if keys:
        buckets = buckets.select(*keys, "_b", *earlier(keys, "_b"))
    else:
        buckets = buckets.withColumn("_run", F.shiftright("_b", _RUN_BITS))
        runs = buckets.groupBy("_run").agg(*totals).select("_run", *earlier([], "_run"))
        runs = runs.withColumnsRenamed({f"{c}_before": f"_{c}_run" for c in folds})
        buckets = buckets.select("_run", "_b", *earlier(["_run"], "_b")).join(runs, "_run").select(
            "_b", *[_plus(kind, F.col(f"{c}_before"), F.col(f"_{c}_run")).alias(f"{c}_before") for c, kind in folds.items()]
        )
    buckets = buckets.withColumnsRenamed({f"{c}_before": f"_{c}_base" for c in folds})
    inside = instants.select(*keys, "_b", at, *folds, *earlier([*keys, "_b"], at))
    return inside.join(buckets, [*keys, "_b"]).select(
        *keys,
        "_b",
        at,
        *folds,
        *[
            _plus(kind, F.col(f"{c}_before"), F.col(f"_{c}_base")).alias(f"{c}_before")
            for c, kind in folds.items()
        ],
    )
