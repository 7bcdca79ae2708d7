"""Changes of tables: order forms, updates and deletes by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.functions.columns import REQUESTED
from seatwise.operators.intervals import active_at
from seatwise.operators.keys import assign_ids
from seatwise.sources.schemas import FOREIGN_KEYS, ForeignKey

PRIMARY_KEY = {
    "roles": "role_id", "users": "user_id", "dining_tables": "table_id",
    "categories": "category_id", "dishes": "dish_id", "bookings": "booking_id",
    "slots": "slot_id", "orders": "order_id", "order_lines": "line_id",
}


def with_active_table(
    forms: DataFrame, slots: DataFrame, bookings: DataFrame, at: Column
) -> DataFrame:
    """Forms without ``table_id`` take the table at which their customer sits at that instant; of
    several slots the one that began last. Customers who sit nowhere keep none."""
    seats = active_at(slots, at).join(bookings.select("booking_id", "customer_id"), "booking_id")
    latest = seats.groupBy("customer_id").agg(
        F.max_by("table_id", F.struct("start", "slot_id")).alias("_seat")
    )
    table = F.coalesce(F.col("table_id"), F.col("_seat")).alias("table_id")
    return forms.join(latest, "customer_id", "left").select(
        *[table if c == "table_id" else c for c in forms.columns]
    )


def split_order_forms(
    forms: DataFrame, existing_orders: DataFrame, order_cols: list[str],
    existing_lines: DataFrame | None = None, requested: Column | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turn submitted forms into (orders, lines, rejected).

    A form has header columns and ``entries``, an array of (dish_id, qty). Entries without
    a positive quantity are dropped; a form without any other is rejected. Ids are given
    to the forms before the entries are unfolded, so header and lines need no join. Lines are
    numbered after those that exist, by order and place in the form; all are ``requested``
    at one instant, by default now.
    """
    wanted = F.filter("entries", lambda e: e["qty"] > 0)
    forms = forms.withColumn("entries", wanted)
    rejected = forms.filter(F.coalesce(F.size("entries"), F.lit(0)) <= 0).drop("entries")
    numbered = assign_ids(
        forms.filter(F.size("entries") > 0), "order_id", order_cols, existing_orders
    )
    lines = assign_ids(
        numbered.select("order_id", F.posexplode("entries").alias("_place", "_e")).select(
            "order_id", "_place", "_e.dish_id", "_e.qty"
        ),
        "line_id", ["order_id", "_place"], existing_lines,
    )
    at = F.current_timestamp() if requested is None else requested
    lines = lines.select(
        "line_id", "dish_id", "order_id", F.lit(REQUESTED).alias("status"), "qty", at.alias("requested")
    )
    return numbered.drop("entries"), lines, rejected


def apply_updates(
    target: DataFrame, changes: DataFrame, key: str, columns: list[str], latest_by: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Set ``columns`` of the rows named by ``key``. Returns (whole new table, changed rows).

    Of several changes for one key the latest by ``latest_by`` wins. They are reduced to
    one per key with map-side combine before the join.
    """
    new = F.struct(*columns)
    latest = changes.groupBy(key).agg(
        F.max_by(new, F.struct(*latest_by, *columns)).alias("_new")
    )

    def updated(df: DataFrame) -> DataFrame:
        return df.select(*[
            F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c))
            .cast(target.schema[c].dataType).alias(c) if c in columns else F.col(c)
            for c in target.columns
        ])

    return updated(target.join(latest, key, "left")), updated(target.join(latest, key))


def _children(table: str, model: dict[str, DataFrame]) -> list[ForeignKey]:
    return [fk for fk in FOREIGN_KEYS if fk.parent == table and fk.child in model]


def _blocked(model: dict[str, DataFrame], table: str, keys: DataFrame) -> DataFrame | None:
    """(key, blocked_by) rows: keys that a restricting reference keeps from deletion,
    directly or through rows that would be deleted with them."""
    key, parts = PRIMARY_KEY[table], []
    for fk in _children(table, model):
        hits = model[fk.child].join(
            keys.select(F.col(key).alias(fk.column)), fk.column, "left_semi"
        )
        if not fk.cascade:
            parts.append(hits.select(F.col(fk.column).alias(key)).distinct().withColumn(
                "blocked_by", F.lit(fk.name)))
        elif fk.child in PRIMARY_KEY and _children(fk.child, model):
            child_key = PRIMARY_KEY[fk.child]
            below = _blocked(model, fk.child, hits.select(child_key))
            if below is not None:
                parts.append(hits.join(below, child_key).select(
                    F.col(fk.column).alias(key), "blocked_by").distinct())
    return reduce(lambda a, b: a.unionByName(b), parts).distinct() if parts else None


def apply_deletes(
    model: dict[str, DataFrame], table: str, keys: DataFrame
) -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """Delete rows of ``table`` by key, following every foreign key.

    Returns (remaining tables, deleted rows per table, refused keys with ``blocked_by``).
    A key referenced through a restricting foreign key is refused as a whole; cascading
    references are deleted along. Each key is judged alone.
    """
    key = PRIMARY_KEY[table]
    keys = keys.select(key).distinct().join(model[table].select(key), key, "left_semi")
    refused = _blocked(model, table, keys)
    if refused is None:
        refused = keys.limit(0).withColumn("blocked_by", F.lit(None).cast("string"))
    else:
        keys = keys.join(refused.select(key).distinct(), key, "left_anti")
    remaining, deleted = dict(model), {}

    def remove(name: str, column: str, values: DataFrame) -> None:
        rows = model[name]
        hit = rows.join(values, column, "left_semi")
        # A table reached by several foreign keys counts the rows still there.
        gone = remaining[name].join(values, column, "left_semi")
        deleted[name] = deleted[name].unionByName(gone) if name in deleted else gone
        remaining[name] = remaining[name].join(values, column, "left_anti")
        for fk in _children(name, model):
            if fk.cascade:
                own = PRIMARY_KEY[name]
                remove(fk.child, fk.column, hit.select(F.col(own).alias(fk.column)).distinct())

    remove(table, key, keys)
    return remaining, deleted, refused
