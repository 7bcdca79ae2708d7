"""Join shapes shared by the listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.functions.columns import CANCELLED


def keep_all(parent: DataFrame, child: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join parent -> child for a child that may pile up on one parent.

    A left join cannot split a hot key on its right side. An inner join can (adaptive
    skew handling, or a broadcast parent), and the parents without children come from an
    anti join against the distinct keys.
    """
    on = [on] if isinstance(on, str) else list(on)
    lonely = parent.join(child.select(*on).distinct(), on, "left_anti")
    return child.join(parent, on).unionByName(lonely, allowMissingColumns=True)


def booked_slots(slots: DataFrame, bookings: DataFrame) -> DataFrame:
    """Slots with the customer, size and status of their booking."""
    return slots.join(bookings, "booking_id")


def blocking_slots(slots: DataFrame, bookings: DataFrame) -> DataFrame:
    """Slots that block their table: every status but cancelled, released included."""
    return booked_slots(slots, bookings.filter(F.col("status") != CANCELLED))


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """Sort with NULLs last when ascending and first when descending ('-' prefix)."""
    return df.orderBy(
        *[F.desc_nulls_first(k[1:]) if k.startswith("-") else F.asc_nulls_last(k) for k in keys]
    )


def top_k(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """First k rows of an ordering; each task keeps k rows, no full sort."""
    return ordered(df, *keys).limit(k)
