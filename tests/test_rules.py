"""The integrity cases: each asserts the exact rule that stops the row."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from seatwise.operators import rules
from seatwise.sources.schemas import FOREIGN_KEYS, ForeignKey
from tests.seed import at, frame


def only(df):
    row = df.first()
    return row["rule"]


def extended(spark, seed, *bookings):
    """Seed bookings plus new ones with ids from 11."""
    new = frame(spark, "bookings", [(11 + i, *b) for i, b in enumerate(bookings)])
    return seed["bookings"].unionByName(new)


def slot_rule(spark, seed, candidate, bookings, slots=None, **kwargs):
    df = rules.check_slots(
        frame(spark, "slots", [candidate]), seed["slots"] if slots is None else slots,
        bookings, seed["dining_tables"], **kwargs)
    return only(df)


def test_case_0_valid_booking_is_accepted(spark, seed):
    booking = frame(spark, "bookings", [(11, 27, 4, 1)])
    checked = rules.check_bookings(booking, seed["role_assignments"], seed["roles"])
    assert rules.accepted(checked).count() == 1
    assert slot_rule(spark, seed, (10, 12, 11, at("17:30"), 7200), extended(spark, seed, (27, 4, 1))) is None


def test_cases_1_to_4_roles(spark, seed):
    people = seed["role_assignments"], seed["roles"]
    checked = rules.check_bookings(frame(spark, "bookings", [(11, 3, 2, 1)]), *people)
    assert checked.first()["message"] == "user 3 lacks the role CUSTOMER"
    assert only(checked) == "not_customer"
    orders = lambda *row: only(rules.check_orders(frame(spark, "orders", [row]), *people))
    assert orders(7, 17, 9, 1) == "not_waiter"
    assert orders(7, 9, 3, 1) == "not_customer"
    assert orders(7, 9, 9, 1) == "not_waiter"       # the waiter is checked first
    assert orders(7, 17, 3, 1) is None
    assert only(rules.check_specialties(frame(spark, "specialties", [(3, 1)]), *people)) == "not_cook"


def test_same_person_needs_both_roles(spark, seed):
    both = seed["role_assignments"].unionByName(frame(spark, "role_assignments", [(5, 3)]))
    checked = rules.check_orders(frame(spark, "orders", [(7, 3, 3, 1)]), both, seed["roles"])
    assert only(checked) == "same_person"


def test_role_names_ignore_case(spark, seed):
    flagged = rules.with_role(
        seed["users"], "user_id", "cook", "f", seed["role_assignments"], seed["roles"])
    assert flagged.filter("f").count() == 8 and flagged.count() == 28


def test_case_5_cook_without_specialty(spark, seed):
    def check(cook, line):
        return only(rules.check_preparations(
            frame(spark, "preparations", [(cook, line)]), seed["order_lines"],
            seed["specialties"], seed["role_assignments"], seed["roles"]))

    assert check(9, 5) == "no_specialty"
    assert check(3, 5) == "not_cook"
    assert check(12, 5) is None
    assert check(12, 999) == "no_specialty"
    stored = rules.check_preparations(
        seed["preparations"], seed["order_lines"], seed["specialties"],
        seed["role_assignments"], seed["roles"])
    assert rules.accepted(stored).count() == 12


def test_cases_6_to_8_slots(spark, seed):
    big, two = extended(spark, seed, (27, 5, 1)), extended(spark, seed, (28, 2, 1))
    assert slot_rule(spark, seed, (10, 1, 11, at("18:00"), 7200), big) == "party_too_big"
    assert slot_rule(spark, seed, (10, 4, 11, at("13:30"), 7200), two) == "table_overlap"
    assert slot_rule(spark, seed, (10, 4, 11, at("14:00"), 7200), two) is None    # touching
    stored = seed["slots"].unionByName(frame(spark, "slots", [(10, 10, 11, at("17:00"), 7200)]))
    assert slot_rule(spark, seed, (11, 11, 11, at("19:30"), 7200), two, stored) == "booking_has_slot"


def test_first_failure_wins(spark, seed):
    b = extended(spark, seed, (27, 5, 1))
    assert slot_rule(spark, seed, (10, 99, 999, at("13:30"), 7200), b) == "booking_missing"
    assert slot_rule(spark, seed, (10, 99, 11, at("13:30"), 7200), b) == "table_missing"
    assert slot_rule(spark, seed, (10, 4, 11, at("13:30"), 7200), b) == "party_too_big"
    assert slot_rule(spark, seed, (10, 4, 2, at("13:30"), 7200), b) == "table_overlap"
    assert slot_rule(spark, seed, (10, 4, 2, at("18:00"), 7200), b) == "booking_has_slot"


def test_cancelled_does_not_block_but_released_does(spark, seed):
    b = extended(spark, seed, (28, 2, 1))
    assert slot_rule(spark, seed, (10, 14, 11, at("09:30"), 7200), b) == "table_overlap"
    cancelled = b.withColumn("status", F.when(F.col("booking_id") == 9, 4).otherwise(F.col("status")))
    assert slot_rule(spark, seed, (10, 14, 11, at("09:30"), 7200), cancelled) is None


def test_capacity_counts_every_touching_booking(spark, seed):
    """Two back-to-back slots on one table both count in a window that straddles them."""
    tables = frame(spark, "dining_tables", [(1, 4), (2, 4)])
    bookings = frame(spark, "bookings", [(1, 17, 4, 1), (2, 18, 4, 2), (3, 19, 1, 1)])
    slots = frame(spark, "slots", [(1, 1, 1, at("12:00"), 3600), (2, 1, 2, at("13:00"), 3600)])
    new = frame(spark, "slots", [(3, 2, 3, at("12:30"), 3600), (4, 2, 3, at("14:00"), 3600)])
    checked = {r["slot_id"]: r for r in rules.check_slots(new, slots, bookings, tables).collect()}
    assert checked[3]["rule"] == "over_capacity"
    assert checked[3]["message"] == "8 people and 1 more are too many for 8 seats"
    assert checked[4]["rule"] is None
    audit = rules.audit_capacity(slots, bookings, tables)
    assert audit.count() == 0


def test_update_leaves_out_the_stored_row(spark, seed):
    checked = rules.check_slots(
        seed["slots"], seed["slots"], seed["bookings"], seed["dining_tables"], update=True)
    assert rules.accepted(checked).count() == 9
    again = rules.check_slots(
        seed["slots"], seed["slots"], seed["bookings"], seed["dining_tables"])
    assert {r["rule"] for r in again.collect()} == {"table_overlap"}
    moved = slot_rule(spark, seed, (2, 5, 2, at("12:30"), 7200), seed["bookings"], update=True)
    assert moved == "table_overlap"     # table 5 is taken by slot 4


@pytest.mark.parametrize("start,duration", [(None, 7200), ("18:00", 0), ("18:00", 10800), ("18:00", None), ("18:00", 10**9)])
def test_invalid_slots_are_refused_last(spark, seed, start, duration):
    b = extended(spark, seed, (27, 4, 1))
    start = start and at(start)
    assert slot_rule(spark, seed, (10, 12, 11, start, duration), b) in ("slot_invalid", "over_capacity")
    assert slot_rule(spark, seed, (10, 12, 11, start, duration), b, seed["slots"].limit(0)) == "slot_invalid"
    assert slot_rule(spark, seed, (10, 99, 11, start, duration), b) == "table_missing"


def test_rules_on_absent_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="slots lacks the columns start, table_id"):
        rules.check_columns(spark.sql("SELECT 1L AS slot_id, 1L AS booking_id, 5L AS duration_s"), "slots")


def test_column_audit_counts_per_rule(spark, seed):
    lines = seed["order_lines"].unionByName(frame(spark, "order_lines", [(13, 4, 1, 99, 1, "2026-04-13 16:00:00")]))
    got = rules.audit_columns({**seed, "order_lines": lines, "users": seed["users"].withColumn("password_digest", F.lit(b"1"))})
    assert [tuple(r) for r in got.collect()] == [("order_lines", "status_invalid", 1)]


@pytest.mark.parametrize("table,row,rule", [
    ("dining_tables", (16, 0), "seats_invalid"),
    ("dining_tables", (16, None), "seats_missing"),
    ("order_lines", (13, 4, 1, 99, 1, "2026-04-13 16:00:00"), "status_invalid"),
    ("order_lines", (13, 4, 1, 1, 0, "2026-04-13 16:00:00"), "qty_invalid"),
    ("slots", (10, 1, 1, at("12:00"), 10800), "duration_s_invalid"),
    ("slots", (10, 1, 1, at("12:00"), 0), "duration_s_invalid"),
    ("slots", (10, 1, 1, None, 7200), "start_missing"),
    ("slots", (10, 1, 1, at("12:00"), 7200), None),
    ("users", (30, "x", b"1", datetime(2026, 1, 1), "l" * 51, None), "login_invalid"),
    ("users", (30, "x", None, datetime(2026, 1, 1), "l", None), "password_digest_missing"),
    ("bookings", (11, 17, 0, 1), "party_size_invalid"),
    ("bookings", (11, 17, 1, 5), "status_invalid"),
    ("orders", (7, 17, 17, 1), "customer_id_invalid"),
])
def test_cases_9_and_10_column_rules(spark, table, row, rule):
    assert only(rules.check_columns(frame(spark, table, [row]), table)) == rule


def test_cases_11_and_12_references(spark, seed):
    new = frame(spark, "order_lines", [
        (13, 9999, 1, 1, 1, "2026-04-13 16:05:00"), (14, 4, 9999, 1, 1, "2026-04-13 16:10:00")])
    model = {**seed, "order_lines": seed["order_lines"].unionByName(new)}
    lost = {r["fk"]: r["n_orphans"] for r in rules.audit_fks(model).collect()}
    assert lost.pop("order_lines.dish_id") == 1 and lost.pop("order_lines.order_id") == 1
    assert set(lost.values()) == {0} and len(lost) == len(FOREIGN_KEYS) - 2
    fk = next(f for f in FOREIGN_KEYS if f.name == "order_lines.dish_id")
    assert [r["line_id"] for r in rules.orphans(model["order_lines"], seed["dishes"], fk).collect()] == [13]


def test_uniques(spark, seed):
    assert rules.audit_uniques(seed).count() == 0
    model = {"specialties": seed["specialties"].unionByName(frame(spark, "specialties", [(9, 4)]))}
    assert [tuple(r) for r in rules.audit_uniques(model).collect()] == [
        ("specialties(cook_id,dish_id)", "9,4", 2)]


def test_stored_audits(spark, seed):
    slots = seed["slots"].unionByName(frame(spark, "slots", [
        (20, 4, 10, at("13:00"), 7200),      # booking 10 is cancelled: no overlap
        (21, 4, 7, at("13:00"), 7200),       # overlaps slot 2; second slot of booking 7
        (22, 1, 3, at("20:00"), 7200),       # party of 6 on 2 seats; second slot of booking 3
    ]))
    found = {tuple(r) for r in rules.audit_overlaps(slots, seed["bookings"], seed["dining_tables"]).collect()}
    assert found == {("overlap", 4, 2, 1), ("overlap", 4, 21, 1), ("party_too_big", 1, 22, None)}
    pairs = rules.overlapping_slots(slots, seed["bookings"]).collect()
    assert [tuple(r) for r in pairs] == [(4, 2, 21)]
    counts = rules.overlap_counts(slots, seed["bookings"]).collect()
    assert sorted(tuple(r) for r in counts) == [(4, 2, 1), (4, 21, 1)]
    repeated = rules.audit_repeated_bookings(slots).collect()
    assert sorted(tuple(r) for r in repeated) == [(3, 2), (7, 2)]


def test_unique_audit_equals_counting_on_random_keys(spark):
    """Keys of one, two and three columns, of text and of time; NULLs, negative and extreme numbers, words shared by many."""
    rng = random.Random(3)
    edge = [None, 0, -1, 63, 64, -64, 2**63 - 1, -2**63]
    rows = [(rng.choice([*edge, *range(-200, 200)]), rng.choice([None, *range(12)]), rng.choice([None, "a", "b", "", "ab"]),
             datetime(2026, 4, 5, rng.randrange(3))) for _ in range(500)]
    names = ["n", "k", "t", "at"]
    df = spark.createDataFrame(rows, "n long, k int, t string, at timestamp_ntz")
    keys = [("n",), ("t",), ("n", "k"), ("k", "t"), ("t", "at"), ("n", "k", "at")]
    want = set()
    for key in keys:
        cells = [tuple(r[names.index(c)] for c in key) for r in rows]
        for cell, n in Counter(c for c in cells if None not in c).items():
            if n > 1:
                want.add((f"x({','.join(key)})", ",".join(map(str, cell)), n))
    got = {tuple(r) for r in rules.audit_uniques({"x": df}, {"x": keys}).collect()}
    assert got == want and len(want) > 100
    assert rules.audit_uniques({"x": df.limit(0)}, {"x": keys}).count() == 0


def test_identifying_column_that_repeats_changes_nothing(spark):
    """A line prepared by two cooks shares its line_id: suspected, and not found guilty."""
    df = spark.createDataFrame([(1, 7), (2, 7), (1, 8), (1, 8), (3, None), (3, None)], "cook_id long, line_id long")
    got = [tuple(r) for r in rules.audit_uniques({"preparations": df}).collect()]
    assert got == [("preparations(cook_id,line_id)", "1,8", 2)]


def test_key_audit_equals_counting_on_random_keys(spark):
    rng = random.Random(4)
    edge = [0, -1, 63, 64, 2**63 - 1, -2**63]
    parents = {*edge[:4], *rng.sample(range(-300, 300), 400)}
    refs = [(rng.choice([None, *edge, *range(-310, 310)]), rng.choice([None, *range(64)])) for _ in range(900)]
    model = {"p": spark.createDataFrame([(p,) for p in parents] + [(None,)], "id long"),
             "c": spark.createDataFrame(refs, "a long, b int")}
    fks = [ForeignKey("c", "a", "p", "id", False), ForeignKey("c", "b", "p", "id", True)]
    got = {r["fk"]: (r["n_rows"], r["n_orphans"]) for r in rules.audit_fks(model, fks).collect()}
    want = {}
    for i, name in enumerate(("c.a", "c.b")):
        seen = [r[i] for r in refs if r[i] is not None]
        want[name] = (len(seen), sum(v not in parents for v in seen))
    assert got == want and want["c.a"][1] > 0
    empty = {name: df.limit(0) for name, df in model.items()}
    assert {tuple(r) for r in rules.audit_fks(empty, fks).collect()} == {("c.a", 0, 0), ("c.b", 0, 0)}
    with pytest.raises(TypeError):
        rules.audit_fks({**model, "p": spark.createDataFrame([("x",)], "id string")}, fks)


def rows_shuffled(df):
    """Rows that all the finished exchanges of a plan without adaptive execution have written."""
    def walk(node):
        own = node.metrics().get("shuffleRecordsWritten")
        kids = node.children()
        return (own.get().value() if own.isDefined() else 0) + sum(walk(kids.apply(i)) for i in range(kids.size()))
    return walk(df._jdf.queryExecution().executedPlan())


def test_audits_shuffle_words_and_no_rows(spark, tmp_path, monkeypatch):
    """100,000 rows in order of their ids: what is shuffled is a word for 64 of them."""
    spark.range(0, 100_000, 1, 4).select("id", F.expr("id DIV 3").alias("up")).write.parquet(f"{tmp_path}/c")
    spark.range(0, 40_000, 1, 4).write.parquet(f"{tmp_path}/p")
    model = {"c": spark.read.parquet(f"{tmp_path}/c"), "p": spark.read.parquet(f"{tmp_path}/p")}
    shuffled = []

    def counted(df, label):
        rows = df.collect()
        shuffled.append(rows_shuffled(df))
        return spark.createDataFrame(rows, df.schema)

    monkeypatch.setattr(rules, "written", counted)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert rules.audit_uniques(model, {"c": [("id",)], "p": [("id",)]}).count() == 0
        rules.audit_fks(model, [ForeignKey("c", "up", "p", "id", False)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(shuffled) == 3 and 0 < shuffled[0] < 2_400 and 0 < shuffled[1] < 1_300
