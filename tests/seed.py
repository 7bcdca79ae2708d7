"""The small restaurant of one Monday: 28 users, 15 tables, 10 bookings, 12 order lines."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.sources.schemas import TABLES

# The seed rows for which the answers of the rule cases and reports are known.
# role, name
ROLES = [
    (1, 'ADMIN'),
    (2, 'MAITRE'),
    (3, 'WAITER'),
    (4, 'COOK'),
    (5, 'CUSTOMER'),
]
# user, role
USER_ROLES = [
    (1, 1),
    (2, 2),
    (3, 3),
    (4, 3),
    (5, 3),
    (6, 3),
    (7, 3),
    (8, 3),
    (9, 4),
    (10, 4),
    (11, 4),
    (12, 4),
    (13, 4),
    (14, 4),
    (15, 4),
    (16, 4),
    (17, 5),
    (18, 5),
    (19, 5),
    (20, 5),
    (21, 5),
    (22, 5),
    (23, 5),
    (24, 5),
    (25, 5),
    (26, 5),
    (27, 5),
    (28, 5),
]
# table, seats
DINING_TABLES = [
    (1, 2),
    (2, 2),
    (3, 2),
    (4, 4),
    (5, 4),
    (6, 4),
    (7, 4),
    (8, 6),
    (9, 6),
    (10, 2),
    (11, 2),
    (12, 4),
    (13, 4),
    (14, 6),
    (15, 8),
]
# category, name
CATEGORIES = [
    (1, 'ENTRADA'),
    (2, 'PLATO FUERTE'),
    (3, 'POSTRE'),
    (4, 'BEBIDA'),
]
# dish, category, preparation minutes, price
DISHES = [
    (1, 1, 15, 9000),
    (2, 1, 18, 12000),
    (3, 1, 12, 10000),
    (4, 2, 35, 32000),
    (5, 2, 40, 28000),
    (6, 2, 45, 30000),
    (7, 2, 35, 29000),
    (8, 2, 30, 24000),
    (9, 2, 32, 31000),
    (10, 3, 10, 11000),
    (11, 3, 8, 9500),
    (12, 4, 5, 7000),
    (13, 4, 6, 8500),
    (14, 4, 4, 5000),
]
# cook, dish
SPECIALTIES = [
    (9, 4),
    (9, 5),
    (10, 6),
    (10, 8),
    (11, 7),
    (11, 4),
    (12, 9),
    (12, 3),
    (13, 1),
    (13, 2),
    (14, 10),
    (14, 11),
    (15, 12),
    (15, 13),
    (16, 14),
    (16, 5),
]
# booking, customer, party, status
BOOKINGS = [
    (1, 17, 2, 2),
    (2, 18, 4, 2),
    (3, 19, 6, 2),
    (4, 20, 4, 2),
    (5, 21, 4, 2),
    (6, 22, 5, 2),
    (7, 23, 4, 1),
    (8, 24, 2, 1),
    (9, 25, 6, 3),
    (10, 26, 3, 4),
]
# slot, table, booking, start
SLOTS = [
    (1, 1, 1, '11:30'),
    (2, 4, 2, '12:00'),
    (3, 8, 3, '12:30'),
    (4, 5, 4, '13:00'),
    (5, 6, 5, '13:15'),
    (6, 9, 6, '13:30'),
    (7, 7, 7, '14:00'),
    (8, 10, 8, '15:00'),
    (9, 14, 9, '09:00'),
]
# order, customer, waiter, table
ORDERS = [
    (1, 17, 3, 1),
    (2, 18, 4, 4),
    (3, 19, 5, 8),
    (4, 20, 6, 5),
    (5, 21, 7, 6),
    (6, 22, 8, 9),
]
# line, dish, order, status, quantity, requested
LINES = [
    (1, 4, 1, 3, 1, '11:40'),
    (2, 12, 1, 3, 2, '11:42'),
    (3, 5, 2, 2, 1, '12:10'),
    (4, 13, 2, 3, 2, '12:12'),
    (5, 9, 3, 1, 2, '12:45'),
    (6, 14, 3, 3, 3, '12:46'),
    (7, 7, 4, 1, 1, '13:05'),
    (8, 2, 4, 2, 2, '13:07'),
    (9, 8, 5, 1, 1, '13:20'),
    (10, 12, 5, 1, 4, '13:22'),
    (11, 6, 6, 2, 1, '13:35'),
    (12, 10, 6, 3, 2, '13:37'),
]
# cook, line
COOKED = [
    (9, 1),
    (15, 2),
    (9, 3),
    (15, 4),
    (12, 5),
    (16, 6),
    (11, 7),
    (13, 8),
    (10, 9),
    (15, 10),
    (10, 11),
    (14, 12),
]


def at(clock: str, day: int = 13) -> datetime:
    return datetime.fromisoformat(f"2026-04-{day:02d} {clock}")


def frame(spark: SparkSession, table: str, rows: list[tuple]) -> DataFrame:
    """Rows of a model table; ``requested`` is given as local time text."""
    schema = TABLES[table]
    if table == "order_lines":
        df = spark.createDataFrame(rows, schema.replace("requested timestamp", "requested string"))
        return df.withColumn("requested", F.to_timestamp("requested"))
    return spark.createDataFrame(rows, schema)


def seed_model(spark: SparkSession) -> dict[str, DataFrame]:
    made = at("08:00", 1)
    rows = {
        "roles": ROLES,
        "users": [(u, f"Person {u:02d}", None, made, f"user{u}", None) for u, _ in USER_ROLES],
        "role_assignments": [(r, u) for u, r in USER_ROLES],
        "dining_tables": DINING_TABLES,
        "categories": CATEGORIES,
        "dishes": [(d, c, f"Dish {d:02d}", None, 60 * m, Decimal(p)) for d, c, m, p in DISHES],
        "specialties": SPECIALTIES,
        "bookings": BOOKINGS,
        "slots": [(s, t, b, at(clock), 7200) for s, t, b, clock in SLOTS],
        "orders": ORDERS,
        "order_lines": [(*line[:5], f"2026-04-13 {line[5]}:00") for line in LINES],
        "preparations": COOKED,
    }
    return {name: frame(spark, name, data) for name, data in rows.items()}
