"""Declared schema of the 12 tables, with their keys and delete rules."""

from __future__ import annotations

from dataclasses import dataclass

TABLES = {
    "roles": "role_id long, name string",
    "users": "user_id long, name string, password_digest binary, digest_ts timestamp_ntz, "
             "login string, token string",
    "role_assignments": "role_id long, user_id long",
    "dining_tables": "table_id long, seats int",
    "categories": "category_id long, name string",
    "dishes": "dish_id long, category_id long, name string, description string, prep_s long, "
              "price decimal(10,2)",
    "bookings": "booking_id long, customer_id long, party_size int, status int",
    "slots": "slot_id long, table_id long, booking_id long, start timestamp_ntz, duration_s long",
    "orders": "order_id long, customer_id long, waiter_id long, table_id long",
    "order_lines": "line_id long, dish_id long, order_id long, status int, qty int, "
                   "requested timestamp",
    "specialties": "cook_id long, dish_id long",
    "preparations": "cook_id long, line_id long",
}

# Columns that must be unique together. NULLs are never duplicates.
UNIQUE_KEYS = {
    "roles": [("role_id",), ("name",)],
    "users": [("user_id",), ("login",)],
    "role_assignments": [("role_id", "user_id")],
    "dining_tables": [("table_id",)],
    "categories": [("category_id",), ("name",)],
    "dishes": [("dish_id",), ("name",)],
    "bookings": [("booking_id",)],
    "slots": [("slot_id", "start")],
    "orders": [("order_id",)],
    "order_lines": [("line_id",)],
    "specialties": [("cook_id", "dish_id")],
    "preparations": [("cook_id", "line_id")],
}

# Columns of a longer key that nearly identify a row by themselves.
IDENTIFYING = {("slots", "slot_id"), ("preparations", "line_id")}


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    parent_key: str
    cascade: bool

    @property
    def name(self) -> str:
        return f"{self.child}.{self.column}"


FOREIGN_KEYS = [
    ForeignKey("role_assignments", "role_id", "roles", "role_id", False),
    ForeignKey("role_assignments", "user_id", "users", "user_id", True),
    ForeignKey("dishes", "category_id", "categories", "category_id", False),
    ForeignKey("bookings", "customer_id", "users", "user_id", False),
    ForeignKey("slots", "table_id", "dining_tables", "table_id", False),
    ForeignKey("slots", "booking_id", "bookings", "booking_id", True),
    ForeignKey("orders", "customer_id", "users", "user_id", False),
    ForeignKey("orders", "waiter_id", "users", "user_id", False),
    ForeignKey("orders", "table_id", "dining_tables", "table_id", False),
    ForeignKey("order_lines", "dish_id", "dishes", "dish_id", False),
    ForeignKey("order_lines", "order_id", "orders", "order_id", True),
    ForeignKey("specialties", "cook_id", "users", "user_id", True),
    ForeignKey("specialties", "dish_id", "dishes", "dish_id", True),
    ForeignKey("preparations", "cook_id", "users", "user_id", False),
    ForeignKey("preparations", "line_id", "order_lines", "line_id", True),
]
