"""Tables and bookings: listings, availability, capacity, what is on now, period reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.functions.columns import (
    AVAILABILITY,
    BOOKING_STATUS,
    OCCUPIED,
    RESERVED,
    TABLE_STATE,
    decode_status,
    epoch_us,
    period,
    slot_end,
)
from seatwise.operators.intervals import (
    BUCKET_US,
    active_at,
    active_at_each,
    bucket,
    in_buckets,
    overlap_sum,
    overlaps_any,
    starting_within,
    with_bounds,
)
from seatwise.operators.joins import blocking_slots, booked_slots, keep_all, ordered

def _end() -> Column:
    return slot_end("start", "duration_s").alias("end")


def instant(at: datetime | str | None) -> Column:
    """A given local time, or the current one."""
    return F.localtimestamp() if at is None else F.lit(str(at)).cast("timestamp_ntz")


def list_tables(tables: DataFrame) -> DataFrame:
    return ordered(tables.select("table_id", "seats"), "table_id")


def total_seats(tables: DataFrame) -> DataFrame:
    return tables.agg(F.sum("seats").alias("total_seats"))


def tables_with_bookings(tables: DataFrame, slots: DataFrame, bookings: DataFrame) -> DataFrame:
    """Every table with its slots; a table without slots appears once."""
    sizes = bookings.select("booking_id", "party_size", F.col("booking_id").alias("_known"))
    taken = slots.join(sizes, "booking_id", "left").select(
        "table_id", "start", _end(), F.col("_known").alias("booking_id"), "party_size"
    )
    rows = keep_all(tables.select("table_id", "seats"), taken, "table_id")
    return ordered(
        rows.select("table_id", "seats", "start", "end", "booking_id", "party_size"),
        "table_id", "start", "booking_id",
    )


def _bookings_named(bookings: DataFrame, users: DataFrame) -> DataFrame:
    names = users.select(F.col("user_id").alias("customer_id"), F.col("name").alias("customer"))
    return bookings.join(names, "customer_id")


def booking_list(
    bookings: DataFrame, users: DataFrame, slots: DataFrame,
    labels: dict[int, str] = BOOKING_STATUS,
) -> DataFrame:
    """All bookings with customer, status label and slot, if they have one."""
    rows = _bookings_named(bookings, users).join(slots, "booking_id", "left")
    return ordered(
        rows.select(
            "booking_id", "customer", "party_size",
            decode_status("status", labels).alias("status"),
            "table_id", "start", "duration_s", _end(),
        ),
        "start", "booking_id",
    )


def customer_bookings(
    bookings: DataFrame, users: DataFrame, slots: DataFrame, customer_id: int | None = None,
    labels: dict[int, str] = BOOKING_STATUS,
) -> DataFrame:
    """Booking history of one customer, or of all."""
    if customer_id is not None:
        bookings = bookings.filter(F.col("customer_id") == customer_id)
    rows = _bookings_named(bookings, users).join(slots, "booking_id", "left")
    return ordered(
        rows.select(
            "customer_id", "customer", "booking_id", "party_size",
            decode_status("status", labels).alias("status"), "table_id", "start",
        ),
        "customer_id", "start", "booking_id",
    )


def table_availability(
    requests: DataFrame, slots: DataFrame, bookings: DataFrame,
    labels: tuple[str, str] = AVAILABILITY,
) -> DataFrame:
    """Is the table of each request free for its whole window?

    Requests: ``table_id``, ``start``, ``duration_s`` and any other columns.
    """
    taken = with_bounds(blocking_slots(slots, bookings))
    asked = overlaps_any(with_bounds(requests), taken, "_taken", ["table_id"])
    answer = F.when(F.col("_taken"), labels[1]).otherwise(labels[0])
    return asked.select(*requests.columns, _end(), answer.alias("availability"))


def live_slots(slots: DataFrame, bookings: DataFrame) -> DataFrame:
    """Slots that count against capacity: reserved or occupied."""
    live = bookings.filter(F.col("status").isin(RESERVED, OCCUPIED))
    return with_bounds(booked_slots(slots, live))


def capacity_usage(
    windows: DataFrame, slots: DataFrame, bookings: DataFrame, tables: DataFrame
) -> DataFrame:
    """People booked in each window (``start``, ``duration_s``) against all seats.

    Every booking that touches the window counts in full, also when two of them do not
    overlap each other.
    """
    booked = overlap_sum(
        with_bounds(windows), live_slots(slots, bookings), "party_size", "people_booked"
    )
    return booked.select(
        *windows.columns, _end(), "people_booked",
        total_seats(tables).scalar().alias("total_seats"),
    )


def upcoming_bookings(
    refs: DataFrame, slots: DataFrame, bookings: DataFrame, users: DataFrame,
    horizon_s: int = 1800,
) -> DataFrame:
    """Reserved bookings starting within the horizon of each reference time ``at``."""
    waiting = booked_slots(slots, bookings.filter(F.col("status") == RESERVED))
    soon = _bookings_named(starting_within(waiting, refs, horizon_s), users)
    return ordered(
        soon.select("at", "booking_id", "customer", "table_id", "start", _end()),
        "at", "start", "booking_id",
    )


def bookings_by_period(slots: DataFrame, bookings: DataFrame, unit: str) -> DataFrame:
    """Bookings and people per calendar day, week or month; all statuses, slot required."""
    rows = booked_slots(slots.select("booking_id", "start"), bookings)
    return ordered(
        rows.groupBy(period("start", unit).alias(unit)).agg(
            F.count("*").alias("total_bookings"), F.sum("party_size").alias("total_people")
        ),
        unit,
    )


def table_board(
    tables: DataFrame, slots: DataFrame, bookings: DataFrame, users: DataFrame,
    orders: DataFrame, at: datetime | str | None = None,
    labels: tuple[str, str, str] = TABLE_STATE, longest_s: int | None = None,
) -> DataFrame:
    """State of every table at an instant: Occupied if the customer seated there ordered
    on that day, else Reserved if a slot covers the instant, else Free.

    ``orders`` need ``customer_id`` and ``placed``.
    """
    now = instant(at)
    seated = active_at(slots, now, longest_s).join(bookings, "booking_id", "left").select(
        "table_id", "customer_id", F.col("status").isNotNull().alias("_booked")
    )
    names = users.select(F.col("user_id").alias("customer_id"), F.col("name").alias("customer"))
    ordering = (
        orders.filter(F.col("placed").cast("date") == now.cast("date"))
        .groupBy("customer_id").agg(F.count("*").alias("_orders"))
    )
    rows = seated.join(names, "customer_id", "left").join(ordering, "customer_id", "left")
    return board_rows(tables, rows.withColumn("_ordered", F.col("_orders") > 0), labels)


def board_rows(tables: DataFrame, seated: DataFrame, labels: tuple[str, str, str] = TABLE_STATE) -> DataFrame:
    """Every table with its state, from the slots that are on: ``table_id``, ``customer``, ``_booked``, ``_ordered``."""
    board = keep_all(tables.select("table_id", "seats"), seated, "table_id")
    state = F.when(F.col("_ordered"), labels[0]).when(F.col("_booked"), labels[1]).otherwise(labels[2])
    return ordered(
        board.select("table_id", "seats", state.alias("state"), "customer"), "table_id", "customer"
    )


def _seated(rows: DataFrame, bookings: DataFrame, users: DataFrame, extra: list[str]) -> DataFrame:
    named = _bookings_named(booked_slots(rows, bookings), users)
    return named.select(*extra, "customer_id", F.col("customer").alias("name"), "booking_id", "table_id")


def seated_customers(
    slots: DataFrame, bookings: DataFrame, users: DataFrame, at: datetime | str | None = None,
    longest_s: int | None = None,
) -> DataFrame:
    """Customers whose slot covers an instant, both ends included."""
    rows = _seated(active_at(slots, instant(at), longest_s), bookings, users, [])
    return ordered(rows, "name", "table_id", "booking_id")


def seated_customers_each(
    instants: DataFrame, slots: DataFrame, bookings: DataFrame, users: DataFrame
) -> DataFrame:
    """The same for a table of instants ``at``."""
    rows = active_at_each(slots, instants.select("at"))
    return ordered(_seated(rows, bookings, users, ["at"]), "at", "name", "table_id", "booking_id")


def booking_order_history(
    bookings: DataFrame, users: DataFrame, slots: DataFrame, orders: DataFrame
) -> DataFrame:
    """All bookings, newest first, with the orders the customer placed at that table
    during the slot (both ends included). ``orders`` need ``placed``.

    Slots and orders meet on customer, table and time bucket, so a customer with a long
    history is spread over time and compared only with orders of the same hours.
    """
    base = _bookings_named(bookings, users).join(slots, "booking_id", "left").select(
        "booking_id", "customer", "status", "table_id"
    )
    taken = with_bounds(slots.join(bookings.select("booking_id", "customer_id"), "booking_id"))
    timed = in_buckets(
        taken.filter(F.col("_s") <= F.col("_e")).select("booking_id", "customer_id", "table_id", "_s", "_e"),
        F.col("_s"), F.col("_e"), BUCKET_US, "_first",
    )
    placed = orders.select(
        "customer_id", "table_id", "order_id", "placed", epoch_us("placed").alias("_t")
    ).withColumn("_bucket", bucket(F.col("_t"), BUCKET_US))
    matched = timed.join(placed, ["customer_id", "table_id", "_bucket"]).filter(
        F.col("_t").between(F.col("_s"), F.col("_e"))
    ).select("booking_id", "table_id", "order_id", "placed").withColumnRenamed("table_id", "_table")
    rows = base.join(
        matched, (base["booking_id"] == matched["booking_id"]) & base["table_id"].eqNullSafe(F.col("_table")), "left"
    )
    return ordered(
        rows.select(base["booking_id"], "customer", "status", "table_id", "order_id", "placed"),
        "-booking_id", "order_id",
    )
