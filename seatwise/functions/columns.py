"""Column expressions: time arithmetic, status labels, money text, digests.

Everything here is a built-in Spark expression, so it stays in the JVM and in
generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status codes and role names of the data model.
BOOKING_STATUS = {1: "reserved", 2: "occupied", 3: "released", 4: "cancelled"}
LINE_STATUS = {1: "requested", 2: "prepared", 3: "delivered"}
AVAILABILITY = ("AVAILABLE", "NOT AVAILABLE")
TABLE_STATE = ("Occupied", "Reserved", "Free")
# The same labels in Spanish.
BOOKING_STATUS_ES = {1: "reservada", 2: "ocupada", 3: "liberada", 4: "cancelada"}
LINE_STATUS_ES = {1: "solicitado", 2: "preparado", 3: "entregado"}
AVAILABILITY_ES = ("DISPONIBLE", "NO DISPONIBLE")
TABLE_STATE_ES = ("Ocupada", "Reservada", "Libre")
RESERVED, OCCUPIED, RELEASED, CANCELLED = 1, 2, 3, 4
REQUESTED, PREPARED, DELIVERED = 1, 2, 3
ADMIN, MAITRE, WAITER, COOK, CUSTOMER = "ADMIN", "MAITRE", "WAITER", "COOK", "CUSTOMER"
STAFF_ROLES = (ADMIN, MAITRE, WAITER, COOK)
MAX_DURATION_S = 7200


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slot_end(start: Column | str, duration_s: Column | str) -> Column:
    """Start plus a duration in seconds; keeps the timestamp type of ``start``."""
    zero = F.lit(0)
    return col(start) + F.make_dt_interval(zero, zero, zero, col(duration_s))


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Half-open ranges [a, b) and [c, d) share an instant. Empty ranges never do."""
    return (a < d) & (c < b) & (a < b) & (c < d)


def epoch_us(ts: Column | str) -> Column:
    """Wall-clock microseconds since 1970.

    For TIMESTAMP_NTZ the value does not depend on the session zone, so the order
    is also kept across daylight-saving changes.
    """
    ts = col(ts)
    return (
        F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000
        + F.hour(ts).cast("long") * 3_600_000_000
        + F.minute(ts).cast("long") * 60_000_000
        + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    )


def wall_clock_as_utc(ts: Column | str) -> Column:
    """TIMESTAMP whose UTC clock shows the wall clock of ``ts``.

    ``withWatermark`` refuses TIMESTAMP_NTZ, and day windows align to UTC; with this
    cast they are the calendar days of the data in any session zone.
    """
    return F.timestamp_micros(epoch_us(ts))


def decode_status(code: Column | str, labels: dict[int, str]) -> Column:
    """Label of a status code; an unknown code gives NULL."""
    code, expr = col(code), None
    for value, label in labels.items():
        expr = F.when(code == value, label) if expr is None else expr.when(code == value, label)
    return expr


def period(ts: Column | str, unit: str) -> Column:
    """First date of the calendar day, ISO week (Monday) or month of ``ts``."""
    day = col(ts).cast("date")
    if unit == "day":
        return day
    if unit not in ("week", "month"):
        raise ValueError(f"unknown period {unit!r}")
    return F.trunc(day, unit)


def line_amount(qty: Column | str, price: Column | str) -> Column:
    return col(qty) * col(price)


def format_amount(amount: Column | str) -> Column:
    """Whole units with '.' between thousands: 325000.00 -> '325.000'.

    Rounds half away from zero first; ``format_number`` alone is half-even.
    """
    return F.translate(F.format_number(F.round(col(amount), 0), 0), ",", ".")


def sha256_digest(text: Column | str) -> Column:
    """SHA-256 of a text as bytes, to pseudonymise a column (unsalted)."""
    return F.unhex(F.sha2(col(text), 256))


def ready_text(order_id: Column | str, waiter: Column | str) -> Column:
    return F.format_string("Order %d waits at the pass for %s", col(order_id), col(waiter))
