"""Row rules and audits as set operations.

Every ``check_*`` function returns its input columns plus ``rule`` (name of the first rule
a row breaks, NULL if accepted) and ``message``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.functions.columns import (
    CANCELLED, COOK, CUSTOMER, MAX_DURATION_S, OCCUPIED, RESERVED, WAITER, overlaps,
)
from seatwise.operators.intervals import overlap_join, overlap_sum, overlaps_any, with_bounds
from seatwise.operators.joins import blocking_slots, booked_slots
from seatwise.sources.schemas import FOREIGN_KEYS, IDENTIFYING, UNIQUE_KEYS, ForeignKey
from seatwise.workspace import cut_lineage, written

Rule = tuple[str, Column, Column]


def _judge(df: DataFrame, columns: list[str], rules: list[Rule]) -> DataFrame:
    """First broken rule per row. Each rule is (name, broken?, message); NULL is not broken."""
    name, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, broken, message in reversed(rules):
        name = F.when(broken, label).otherwise(name)
        text = F.when(broken, message).otherwise(text)
    return df.select(*columns, name.alias("rule"), text.alias("message"))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("rule").isNull()).drop("rule", "message")


# roles ------------------------------------------------------------------------


def with_role(
    df: DataFrame, user_col: str, role: str, flag: str, assignments: DataFrame, roles: DataFrame
) -> DataFrame:
    """Add ``flag``: does the user in ``user_col`` hold ``role`` (any letter case)?"""
    holders = (
        assignments.join(roles.filter(F.upper("name") == role.upper()).select("role_id"), "role_id")
        .select(F.col("user_id").alias(user_col), F.lit(True).alias(flag))
        .distinct()
    )
    return df.join(holders, user_col, "left").select(
        *df.columns, F.coalesce(F.col(flag), F.lit(False)).alias(flag)
    )


def _lacks(user_col: str, role: str, flag: str) -> Rule:
    text = F.format_string(f"user %s lacks the role {role}", F.col(user_col))
    return (f"not_{role.lower()}", ~F.col(flag), text)


def check_bookings(bookings: DataFrame, assignments: DataFrame, roles: DataFrame) -> DataFrame:
    """A booking is made by a customer."""
    df = with_role(bookings, "customer_id", CUSTOMER, "_customer", assignments, roles)
    return _judge(df, bookings.columns, [_lacks("customer_id", CUSTOMER, "_customer")])


def check_orders(orders: DataFrame, assignments: DataFrame, roles: DataFrame) -> DataFrame:
    """The waiter is a waiter, the customer a customer, and they differ; in that order."""
    df = with_role(orders, "waiter_id", WAITER, "_waiter", assignments, roles)
    df = with_role(df, "customer_id", CUSTOMER, "_customer", assignments, roles)
    same = F.col("customer_id") == F.col("waiter_id")
    return _judge(df, orders.columns, [
        _lacks("waiter_id", WAITER, "_waiter"),
        _lacks("customer_id", CUSTOMER, "_customer"),
        ("same_person", same, F.format_string("user %s would wait on themselves", F.col("waiter_id"))),
    ])


def check_specialties(
    specialties: DataFrame, assignments: DataFrame, roles: DataFrame
) -> DataFrame:
    """Only cooks have specialties."""
    df = with_role(specialties, "cook_id", COOK, "_cook", assignments, roles)
    return _judge(df, specialties.columns, [_lacks("cook_id", COOK, "_cook")])


def check_preparations(
    preparations: DataFrame, lines: DataFrame | None, specialties: DataFrame,
    assignments: DataFrame, roles: DataFrame,
) -> DataFrame:
    """A preparation is done by a cook who knows the dish of the line.

    Preparations name their line by ``line_id``; those that already carry ``dish_id``
    (sources without line ids) need no ``lines``.
    """
    df = preparations
    if lines is not None:
        df = df.join(lines.select("line_id", "dish_id"), "line_id", "left")
    df = with_role(df, "cook_id", COOK, "_cook", assignments, roles)
    known = specialties.select("cook_id", "dish_id").distinct().withColumn("_knows", F.lit(True))
    df = df.join(known, ["cook_id", "dish_id"], "left")
    what = ("line %s", "line_id") if lines is not None else ("dish %s", "dish_id")
    return _judge(df, preparations.columns, [
        _lacks("cook_id", COOK, "_cook"),
        ("no_specialty", F.col("_knows").isNull(), F.format_string(
            f"{what[0]} is beyond the specialties of cook %s", F.col(what[1]), F.col("cook_id"))),
    ])


# slots ------------------------------------------------------------------------


def placement_rules() -> list[Rule]:
    """Booking and table exist, and the party fits. Needs ``party_size`` and ``seats``."""
    return [
        ("booking_missing", F.col("party_size").isNull(),
         F.format_string("no booking %s is known", F.col("booking_id"))),
        ("table_missing", F.col("seats").isNull(),
         F.format_string("no table %s is known", F.col("table_id"))),
        ("party_too_big", F.col("party_size") > F.col("seats"),
         F.format_string("a party of %s is more than the %s seats of table %s",
                         F.col("party_size"), F.col("seats"), F.col("table_id"))),
    ]


def table_overlap_rule(broken: Column) -> Rule:
    return ("table_overlap", broken, F.format_string(
        "table %s is taken for part of that time", F.col("table_id")))


def booking_has_slot_rule(broken: Column) -> Rule:
    return ("booking_has_slot", broken, F.format_string(
        "booking %s has its slot", F.col("booking_id")))


def over_capacity_rule(taken: Column, total: Column) -> Rule:
    return ("over_capacity", taken + F.col("party_size") > total, F.format_string(
        "%s people and %s more are too many for %s seats", taken, F.col("party_size"), total))


def valid_slot() -> Column:
    """A start, and a duration within the allowed range."""
    in_range = F.coalesce(F.col("duration_s").between(1, MAX_DURATION_S), F.lit(False))
    return in_range & F.col("start").isNotNull()


def slot_invalid_rule() -> Rule:
    return ("slot_invalid", ~valid_slot(), F.lit("a slot starts at some time and lasts up to 2 hours"))


def with_placement(candidates: DataFrame, bookings: DataFrame, tables: DataFrame) -> DataFrame:
    sizes = bookings.select("booking_id", "party_size", "status")
    return candidates.join(sizes, "booking_id", "left").join(
        tables.select("table_id", "seats"), "table_id", "left"
    )


def stored_slots(slots: DataFrame, bookings: DataFrame) -> DataFrame:
    """Slots with their bounds and with the size and status of their booking, written once:
    the checks of a batch read them several times."""
    rows = with_bounds(booked_slots(slots, bookings.select("booking_id", "party_size", "status")))
    return cut_lineage(rows.select("slot_id", "table_id", "booking_id", "_s", "_e", "party_size", "status"))


def with_stored_conflicts(
    placed: DataFrame, candidates: DataFrame, stored: DataFrame, update: bool = False
) -> DataFrame:
    """Add ``_crossed`` (does a stored slot block the table then?) and ``_slots`` (stored slots
    of the booking). ``placed`` are the ``candidates`` with more columns, ``stored`` comes from
    ``stored_slots``. With ``update`` a stored row of the same ``slot_id`` is left out.

    Overlaps come from running totals and slots from a grouped count: a busy table or a
    much-repeated booking makes no pairs.
    """
    blocking = stored.filter(F.col("status") != CANCELLED)
    if update:
        df = overlap_sum(placed, blocking, F.lit(1), "_overlaps", ["table_id"], candidates)
    else:
        df = overlaps_any(placed, blocking, "_crossed", ["table_id"], candidates)
    per_booking = stored.groupBy("booking_id").agg(F.count("*").alias("_slots"))
    df = df.join(per_booking, "booking_id", "left").withColumn(
        "_slots", F.coalesce("_slots", F.lit(0))
    )
    if not update:
        return df
    own = stored.select(
        "slot_id", F.col("table_id").alias("_own_table"), F.col("booking_id").alias("_own_booking"),
        F.col("_s").alias("_own_s"), F.col("_e").alias("_own_e"),
        F.col("status").alias("_own_status"), F.col("party_size").alias("_own_size"),
    )
    touches = overlaps(F.col("_s"), F.col("_e"), F.col("_own_s"), F.col("_own_e"))
    blocks = touches & (F.col("_own_status") != CANCELLED) & (F.col("_own_table") == F.col("table_id"))
    counts = touches & F.col("_own_status").isin(RESERVED, OCCUPIED)
    return df.join(own, "slot_id", "left").select(
        *placed.columns,
        (F.col("_overlaps") > F.when(blocks, 1).otherwise(0)).alias("_crossed"),
        (F.col("_slots") - F.when(F.col("_own_booking") == F.col("booking_id"), 1).otherwise(0))
        .alias("_slots"),
        F.when(counts, F.col("_own_size")).otherwise(0).alias("_own_people"),
    )


def check_slots(
    candidates: DataFrame, slots: DataFrame, bookings: DataFrame, tables: DataFrame,
    update: bool = False,
) -> DataFrame:
    """All placement rules of new slots (or of changed ones, with ``update``) against the
    stored slots. Each candidate is judged alone; see ``admit_slots`` for a batch in which
    earlier candidates count.

    First failure wins: booking missing, table missing, party too big, table overlap,
    booking already has a slot, restaurant capacity exceeded, start or duration invalid.
    """
    placed = cut_lineage(with_placement(with_bounds(candidates), bookings, tables))
    stored = stored_slots(slots, bookings)
    df = with_stored_conflicts(placed, placed, stored, update)
    live = stored.filter(F.col("status").isin(RESERVED, OCCUPIED))
    df = overlap_sum(df, live, "party_size", "_people", bounds_from=placed)
    people = F.col("_people") - F.col("_own_people") if update else F.col("_people")
    df = df.withColumn("_taken", people).withColumn(
        "_capacity", tables.agg(F.coalesce(F.sum("seats"), F.lit(0))).scalar()
    )
    return _judge(df, candidates.columns, [
        *placement_rules(),
        table_overlap_rule(F.col("_crossed")),
        booking_has_slot_rule(F.col("_slots") > 0),
        over_capacity_rule(F.col("_taken"), F.col("_capacity")),
        slot_invalid_rule(),
    ])


# column constraints --------------------------------------------------------------


def _required(*names: str) -> list[Rule]:
    return [(f"{n}_missing", F.col(n).isNull(), F.lit(f"{n} is required")) for n in names]


def _is(name: str, ok: Column, text: str) -> Rule:
    return (f"{name}_invalid", ~ok, F.lit(text))


def column_rules(table: str) -> list[Rule]:
    """NOT NULL, range, code and length rules of a table.

    Fixed values: which columns are required, and the ranges, codes and lengths.
    """
    c = F.col
    rules = {
        "roles": _required("name"),
        "categories": _required("name"),
        "users": _required("name", "password_digest", "digest_ts") + [
            _is("login", F.length("login") <= 50, "login is longer than 50"),
            _is("token", F.length("token") <= 13, "token is longer than 13"),
        ],
        "role_assignments": _required("role_id", "user_id"),
        "dining_tables": _required("seats") + [_is("seats", c("seats") > 0, "seats must be positive")],
        "dishes": _required("category_id", "name", "prep_s", "price") + [
            _is("prep_s", c("prep_s") > 0, "preparation time must be positive"),
            _is("price", c("price") >= 0, "price must not be negative"),
        ],
        "bookings": _required("customer_id", "party_size", "status") + [
            _is("party_size", c("party_size") > 0, "party size must be positive"),
            _is("status", c("status").isin(1, 2, 3, 4), "status must be 1 to 4"),
        ],
        "slots": _required("table_id", "booking_id", "start", "duration_s") + [
            _is("duration_s", c("duration_s").between(1, MAX_DURATION_S),
                "duration must be positive and at most 2 hours"),
        ],
        "orders": _required("customer_id", "waiter_id", "table_id") + [
            _is("customer_id", c("customer_id") != c("waiter_id"), "customer and waiter must differ"),
        ],
        "order_lines": _required("dish_id", "order_id", "status", "qty", "requested") + [
            _is("status", c("status").isin(1, 2, 3), "status must be 1 to 3"),
            _is("qty", c("qty") > 0, "quantity must be positive"),
        ],
        "specialties": _required("cook_id", "dish_id"),
        "preparations": _required("cook_id", "line_id"),
    }
    return rules[table]


def check_columns(df: DataFrame, table: str) -> DataFrame:
    """Column constraints of a model table, in one projection. A column that has rules and
    is not there raises an error: nothing could be said about it."""
    wanted = column_rules(table)
    absent = sorted({r[0].rsplit("_", 1)[0] for r in wanted} - set(df.columns))
    if absent:
        raise ValueError(f"{table} lacks the columns {', '.join(absent)}")
    return _judge(df, df.columns, wanted)


def audit_columns(model: dict[str, DataFrame]) -> DataFrame:
    """Per table and column rule: how many rows break it first. Rules that hold are not listed."""
    parts = [
        check_columns(rows, name).filter(F.col("rule").isNotNull())
        .groupBy("rule").agg(F.count("*").alias("n"))
        .select(F.lit(name).alias("table_name"), "rule", "n")
        for name, rows in model.items()
    ]
    return _union(parts)


# audits of stored data -------------------------------------------------------------


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# Values that are whole numbers are held as bits, 64 to a word. Files keep neighbouring numbers together, so a task
# folds up to 64 rows into one word before the shuffle, and only rows of words that show a fault are looked at singly.
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _bit(value: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), value.bitwiseAND(F.lit(63)).cast("int"))


def audit_uniques(
    model: dict[str, DataFrame], keys: dict[str, list[tuple[str, ...]]] | None = None
) -> DataFrame:
    """Key values stored more than once, and how often. NULLs are not duplicates.

    A key's suspects come first: rows are folded to words of 64 values of one whole-number column, ``IDENTIFYING``
    where that column nearly identifies a row, with the rest of the key otherwise. A word with more rows than
    bits holds a repeated value. Keys without such a column are folded by their hash. Rows of suspect words alone are
    then counted by their whole key, so a hash or a column that repeats costs a count and changes nothing.
    Each table is read once for the words, and once for suspects if there are any.
    """
    words, whole = [], []
    for table, all_keys in (UNIQUE_KEYS if keys is None else keys).items():
        if table not in model:
            continue
        kinds = dict(model[table].dtypes)
        own = []
        for key in all_keys:
            values = [F.col(k) for k in key]
            known = reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
            numbers = [k for k in key if kinds[k] in _WHOLE]
            packed = next((k for k in numbers if (table, k) in IDENTIFYING), numbers[-1] if numbers else None)
            if packed is None:
                value, rest = F.xxhash64(*values), []
            else:
                value = F.col(packed).cast("long")
                rest = [] if (table, packed) in IDENTIFYING else [F.col(k) for k in key if k != packed]
            name = F.lit(f"{table}({','.join(key)})")
            own.append(F.struct(
                # One long stands for constraint, rest and word: where two fall together, there is no bit less.
                F.xxhash64(name, *rest, F.shiftright(value, 6)).alias("_word"), F.when(known, _bit(value)).alias("_bits"),
                name.alias("constraint"), F.array(*[v.cast("string") for v in values]).alias("_key"),
            ))
        rows = model[table].select(F.inline(F.array(*own))).filter(F.col("_bits").isNotNull())
        words.append(rows.select("_word", "_bits"))
        whole.append(rows.drop("_bits"))
    # Written, so that the next plan knows how few they are.
    suspects = written(_union(words).groupBy("_word").agg(F.count("*").alias("_n"), F.bit_or("_bits").alias("_bits")).filter(
        F.col("_n") > F.bit_count("_bits")).select("_word"), "suspects")
    counted = _union(whole).join(suspects, "_word", "left_semi").groupBy("constraint", "_key").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") > 1).select(
        "constraint", F.array_join("_key", ",").alias("key"), "n"
    )


def orphans(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """Child rows whose reference has no parent. A NULL reference is not an orphan."""
    keys = parent.select(F.col(fk.parent_key).alias(fk.column))
    return child.filter(F.col(fk.column).isNotNull()).join(keys, fk.column, "left_anti")


def audit_fks(model: dict[str, DataFrame], fks: list[ForeignKey] | None = None) -> DataFrame:
    """Per foreign key with both tables present: rows, and rows whose parent is missing.

    References and parent keys are folded to words of 64 values with map-side combine: bits of the keys that exist, and
    bits of those referred to per foreign key. Where a word has references without a parent, its rows are counted
    by value; they meet the word's parent bits in a join. Keys must be whole numbers, as all of the model are. A value that
    most rows share is one bit. Each table is read once as child and once as parent, and children again only
    if there are orphans.
    """
    fks = [
        fk for fk in (FOREIGN_KEYS if fks is None else fks) if fk.child in model and fk.parent in model
    ]
    for fk in fks:
        for table, column in ((fk.child, fk.column), (fk.parent, fk.parent_key)):
            if dict(model[table].dtypes)[column] not in _WHOLE:
                raise TypeError(f"{table}.{column} is not a whole number")

    def values(table: str, refs: list[tuple[str, str, int]]) -> DataFrame:
        own = [
            F.struct(F.lit(parent).alias("parent"), F.col(column).cast("long").alias("value"), F.lit(i).alias("fk"))
            for parent, column, i in refs
        ]
        rows = model[table].select(F.inline(F.array(*own))).filter(F.col("value").isNotNull())
        return rows.withColumn("_word", F.shiftright("value", 6)).withColumn("_bit", _bit(F.col("value")))

    children = _union([
        values(child, [(f"{fk.parent}.{fk.parent_key}", fk.column, i) for i, fk in enumerate(fks) if fk.child == child])
        for child in dict.fromkeys(fk.child for fk in fks)
    ])
    parents = _union([
        values(parent, [(f"{parent}.{key}", key, -1)]) for parent, key in dict.fromkeys((fk.parent, fk.parent_key) for fk in fks)
    ])
    words = written(children.unionByName(parents).groupBy("parent", "_word", "fk").agg(
        F.bit_or("_bit").alias("_bits"), F.count("*").alias("n")), "key-words")
    there, asked = (F.coalesce(F.bit_or(F.when(c, F.col("_bits"))), F.lit(0)) for c in (F.col("fk") == -1, F.col("fk") != -1))
    lacking = written(words.groupBy("parent", "_word").agg(there.alias("_there"), asked.alias("_asked")).filter(
        F.col("_asked").bitwiseAND(F.bitwise_not("_there")) != 0).drop("_asked"), "lacking")
    lost = children.join(lacking, ["parent", "_word"]).filter(F.col("_bit").bitwiseAND(F.col("_there")) == 0)
    per = words.select("fk", "n", F.lit(0).cast("long").alias("lost")).unionByName(
        lost.groupBy("fk").agg(F.count("*").alias("lost")).select("fk", F.lit(0).cast("long").alias("n"), "lost"))
    is_fk = [F.col("fk") == i for i in range(len(fks))]
    totals = per.agg(*[
        F.coalesce(F.sum(F.when(f, F.col(c))), F.lit(0)).alias(f"{c}_{i}") for i, f in enumerate(is_fk) for c in ("n", "lost")])
    rows = [
        F.struct(F.lit(fk.name).alias("fk"), F.col(f"n_{i}").alias("n_rows"), F.col(f"lost_{i}").alias("n_orphans"))
        for i, fk in enumerate(fks)
    ]
    return totals.select(F.inline(F.array(*rows)))


def overlapping_slots(slots: DataFrame, bookings: DataFrame) -> DataFrame:
    """Pairs of stored, non-cancelled slots of one table that overlap."""
    rows = with_bounds(blocking_slots(slots, bookings)).select("table_id", "slot_id", "_s", "_e")
    pairs = overlap_join(rows, rows, ["table_id"], F.col("slot_id") < F.col("slot_id_2"))
    return pairs.select("table_id", "slot_id", F.col("slot_id_2").alias("other_slot_id"))


def overlap_counts(slots: DataFrame, bookings: DataFrame) -> DataFrame:
    """Non-cancelled slots that overlap others on their table, with how many. One row per
    slot whatever the number of pairs, for tables too crowded to list pairs."""
    rows = with_bounds(blocking_slots(slots, bookings)).select("slot_id", "table_id", "_s", "_e")
    counted = overlap_sum(rows, rows, F.lit(1), "_n", ["table_id"])
    return counted.filter(F.col("_n") > 1).select(
        "table_id", "slot_id", (F.col("_n") - 1).alias("n_overlaps")
    )


def oversized_parties(slots: DataFrame, bookings: DataFrame, tables: DataFrame) -> DataFrame:
    """Stored slots whose party no longer fits the table."""
    rows = booked_slots(slots, bookings).join(tables, "table_id")
    return rows.filter(F.col("party_size") > F.col("seats")).select(
        "table_id", "slot_id", "party_size", "seats"
    )


def audit_overlaps(slots: DataFrame, bookings: DataFrame, tables: DataFrame) -> DataFrame:
    """Both kinds of stored violations, which later changes of a booking's status or size
    or of a table can cause: slots that overlap others on their table, with how many, and
    parties larger than their table. One row per slot and kind; ``overlapping_slots`` lists pairs."""
    crossed = overlap_counts(slots, bookings).withColumn("kind", F.lit("overlap"))
    large = oversized_parties(slots, bookings, tables).select(
        "table_id", "slot_id", F.lit(None).cast("long").alias("n_overlaps"),
        F.lit("party_too_big").alias("kind"),
    )
    return crossed.unionByName(large).select("kind", "table_id", "slot_id", "n_overlaps")


def audit_repeated_bookings(slots: DataFrame) -> DataFrame:
    """Bookings with more than one slot."""
    counted = slots.groupBy("booking_id").agg(F.count("*").alias("n_slots"))
    return counted.filter(F.col("n_slots") > 1)


def audit_capacity(
    slots: DataFrame, bookings: DataFrame, tables: DataFrame, total: Column | None = None
) -> DataFrame:
    """Live slots during which the people booked exceed the seats of the restaurant."""
    live = with_bounds(booked_slots(slots, bookings.filter(F.col("status").isin(RESERVED, OCCUPIED))))
    total = tables.agg(F.coalesce(F.sum("seats"), F.lit(0))).scalar() if total is None else total
    return (
        overlap_sum(live, live, "party_size", "people_booked")
        .withColumn("total_seats", total)
        .filter(F.col("people_booked") > F.col("total_seats"))
        .select("slot_id", "table_id", "people_booked", "total_seats")
    )
