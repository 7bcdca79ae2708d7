"""Users, roles and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.functions.columns import STAFF_ROLES
from seatwise.operators.joins import ordered


def _with_roles(users: DataFrame, assignments: DataFrame, roles: DataFrame) -> DataFrame:
    named = assignments.join(roles.select("role_id", F.col("name").alias("role")), "role_id")
    return users.join(named, "user_id")


def staff_by_role(
    users: DataFrame, assignments: DataFrame, roles: DataFrame,
    staff: tuple[str, ...] = STAFF_ROLES,
) -> DataFrame:
    wanted = roles.filter(F.col("name").isin(*staff))
    rows = _with_roles(users.select("user_id", "name"), assignments, wanted)
    return ordered(rows.select("role", "user_id", "name"), "role", "name", "user_id")


def user_directory(users: DataFrame, assignments: DataFrame, roles: DataFrame) -> DataFrame:
    """Users and their roles; digests and tokens are never part of it."""
    people = users.select("user_id", "name", "login")
    named = assignments.join(roles.select("role_id", F.col("name").alias("role")), "role_id")
    rows = people.join(named.select("user_id", "role"), "user_id", "left")
    return ordered(rows.select("user_id", "name", "login", "role"), "user_id", "role")


def system_counts(users: DataFrame, orders: DataFrame) -> DataFrame:
    return users.agg(F.count("*").alias("total_users")).select(
        "total_users", orders.agg(F.count("*")).scalar().alias("total_orders")
    )


def cook_dishes(specialties: DataFrame, users: DataFrame, dishes: DataFrame) -> DataFrame:
    cooks = users.select(F.col("user_id").alias("cook_id"), F.col("name").alias("cook"))
    names = dishes.select("dish_id", F.col("name").alias("dish"))
    rows = specialties.join(cooks, "cook_id").join(names, "dish_id")
    return ordered(rows.select("cook_id", "cook", "dish_id", "dish"), "cook", "dish", "cook_id", "dish_id")
