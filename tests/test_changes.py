"""Keys, order forms, updates, deletes, appends and the month layout."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seatwise.operators import changes, keys, rules
from seatwise.sources.schemas import TABLES
from seatwise.sources.tables import (
    append_once, append_rows, change_slots, load_model, read_appended, read_slots_between, with_defaults,
    write_slots_by_month,
)
from tests.seed import at, frame


def test_ids_continue_after_the_highest(spark, seed):
    new = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = keys.assign_ids(new, "table_id", ["v"], seed["dining_tables"], n_parts=7)
    assert [(r["v"], r["table_id"]) for r in got.orderBy("v").collect()] == [(i, i + 16) for i in range(1000)]
    first = keys.assign_ids(spark.range(3), "n", ["id"])
    assert sorted(r["n"] for r in first.collect()) == [1, 2, 3]


def test_names_resolve_or_are_rejected(spark, seed):
    new = spark.createDataFrame([("a", "POSTRE"), ("b", "SOPA"), ("c", None)], "dish string, category string")
    ok, bad = keys.resolve_names(new, "category", seed["categories"], "name", "category_id")
    assert [tuple(r) for r in ok.collect()] == [("a", 3)]
    assert sorted((r["dish"], r["reason"]) for r in bad.collect()) == [("b", "unknown name"), ("c", "unknown name")]
    twice = seed["categories"].unionByName(frame(spark, "categories", [(9, "POSTRE")]))
    ok, bad = keys.resolve_names(new, "category", twice, "name", "category_id")
    assert ok.count() == 0 and bad.filter("reason = 'ambiguous name'").count() == 1


def test_table_demo(spark, seed):
    """Add a table of 4, make it 6, delete it again."""
    new = keys.assign_ids(spark.sql("SELECT 4 AS seats"), "table_id", ["seats"], seed["dining_tables"])
    assert new.first()["table_id"] == 16
    tables = seed["dining_tables"].unionByName(new.select("table_id", F.col("seats").cast("int")))
    change = spark.sql("SELECT 16L AS table_id, 6 AS seats, 1 AS step")
    tables, changed = changes.apply_updates(tables, change, "table_id", ["seats"], ["step"])
    assert [tuple(r) for r in changed.collect()] == [(16, 6)] and tables.count() == 16
    left, deleted, refused = changes.apply_deletes(
        {**seed, "dining_tables": tables}, "dining_tables", spark.sql("SELECT 16L AS table_id"))
    assert [tuple(r) for r in deleted["dining_tables"].collect()] == [(16, 6)]
    assert left["dining_tables"].count() == 15 and refused.count() == 0


def test_menu_demo(spark, seed):
    asked = spark.createDataFrame(
        [("POSTRE", "Wafer", 420, Decimal("12000.00"))],
        "category string, name string, prep_s long, price decimal(10,2)")
    ok, _ = keys.resolve_names(asked, "category", seed["categories"], "name", "category_id")
    new = with_defaults(keys.assign_ids(ok, "dish_id", ["name"], seed["dishes"]), "dishes")
    row = new.first()
    assert (row["dish_id"], row["category_id"], row["description"]) == (15, 3, None)
    dishes = seed["dishes"].unionByName(new)
    price = spark.sql("SELECT 15L AS dish_id, 13000.00BD AS price, 1 AS step")
    dishes, changed = changes.apply_updates(dishes, price, "dish_id", ["price"], ["step"])
    assert changed.first()["price"] == Decimal("13000.00")
    _, deleted, _ = changes.apply_deletes({**seed, "dishes": dishes}, "dishes", spark.sql("SELECT 15L AS dish_id"))
    assert deleted["dishes"].count() == 1


def test_order_demo(spark, seed):
    forms = spark.createDataFrame(
        [(1, 24, 3, 10, [(4, 1), (12, 2), (7, 0)]), (2, 24, 3, 10, [(4, 0)]), (3, 25, 4, 11, []), (4, 26, 3, 1, None)],
        "form_id long, customer_id long, waiter_id long, table_id long, entries array<struct<dish_id: long, qty: int>>")
    heads, lines, rejected = changes.split_order_forms(forms, seed["orders"], ["form_id"])
    assert [(r["order_id"], r["customer_id"]) for r in heads.collect()] == [(7, 24)]
    assert lines.columns == ["line_id", "dish_id", "order_id", "status", "qty", "requested"]
    assert sorted(tuple(r)[:5] for r in lines.collect()) == [(1, 4, 7, 1, 1), (2, 12, 7, 1, 2)]
    _, lines, _ = changes.split_order_forms(forms, seed["orders"], ["form_id"], seed["order_lines"], F.lit(at("12:00")))
    assert sorted((r["line_id"], r["requested"]) for r in lines.collect()) == [(13, at("12:00")), (14, at("12:00"))]
    assert sorted(r["form_id"] for r in rejected.collect()) == [2, 3, 4]


def test_orders_take_the_table_of_the_seated_customer(spark, seed):
    forms = spark.createDataFrame([(1, 18, None), (2, 18, 3), (3, 26, None)], "form_id long, customer_id long, table_id long")
    when = F.lit(str(at("12:30"))).cast("timestamp_ntz")
    got = changes.with_active_table(forms, seed["slots"], seed["bookings"], when)
    assert got.columns == forms.columns
    assert {r["form_id"]: r["table_id"] for r in got.collect()} == {1: 4, 2: 3, 3: None}


def test_too_long_slots_are_not_stored(spark, tmp_path):
    long = frame(spark, "slots", [(1, 1, 1, at("12:00"), 7201)])
    for write in (lambda: append_rows(long, "slots", str(tmp_path)), lambda: write_slots_by_month(long, str(tmp_path / "m"))):
        with pytest.raises(Exception, match="slot 1 lasts 7201 s"):
            write()


def test_latest_change_wins_and_null_is_a_value(spark, seed):
    updates = spark.createDataFrame([(5, 2, 1), (5, 3, 2), (6, None, 1), (99, 1, 1)], "line_id long, status int, step int")
    table, changed = changes.apply_updates(seed["order_lines"], updates, "line_id", ["status"], ["step"])
    got = {r["line_id"]: r["status"] for r in table.collect()}
    assert len(got) == 12 and got[5] == 3 and got[6] is None and got[1] == 3
    assert sorted(r["line_id"] for r in changed.collect()) == [5, 6]


def test_deletes_follow_references(spark, seed):
    ids = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} long")
    left, deleted, refused = changes.apply_deletes(seed, "orders", ids("order_id", 1, 77))
    assert deleted["orders"].count() == 1 and deleted["order_lines"].count() == 2
    assert deleted["preparations"].count() == 2 and refused.count() == 0
    assert left["order_lines"].count() == 10 and left["preparations"].count() == 10
    assert rules.audit_fks(left).filter("n_orphans > 0").count() == 0
    left, deleted, refused = changes.apply_deletes(seed, "users", ids("user_id", 2, 9, 17, 27))
    assert sorted(r["user_id"] for r in deleted["users"].collect()) == [2, 27]
    assert sorted(tuple(r) for r in refused.collect()) == [
        (9, "preparations.cook_id"), (17, "bookings.customer_id"), (17, "orders.customer_id")]
    assert left["role_assignments"].count() == 26
    left, deleted, _ = changes.apply_deletes(seed, "bookings", ids("booking_id", 1))
    assert deleted["slots"].count() == 1 and left["slots"].count() == 8
    _, deleted, refused = changes.apply_deletes(seed, "dishes", ids("dish_id", 3, 4))
    assert [r["dish_id"] for r in deleted["dishes"].collect()] == [3]
    assert deleted["specialties"].count() == 1 and refused.first()["blocked_by"] == "order_lines.dish_id"


def test_append_fills_defaults(spark, tmp_path):
    append_rows(spark.createDataFrame([(1, 17, 2)], "booking_id long, customer_id long, party_size int"), "bookings", str(tmp_path))
    append_rows(spark.createDataFrame([(2, 18, 2, 2)], "booking_id long, customer_id long, party_size int, status int"), "bookings", str(tmp_path))
    append_rows(spark.createDataFrame([(1, 4, 1, at("12:00"))], "slot_id long, table_id long, booking_id long, start timestamp_ntz"), "slots", str(tmp_path))
    append_rows(spark.createDataFrame([(1, 4, 1, 2)], "line_id long, dish_id long, order_id long, qty int"), "order_lines", str(tmp_path))
    model = load_model(spark, str(tmp_path), ["bookings", "slots", "order_lines"])
    assert sorted(r["status"] for r in model["bookings"].collect()) == [1, 2]
    assert model["slots"].first()["duration_s"] == 7200
    line = model["order_lines"].first()
    assert line["status"] == 1 and line["requested"] is not None


def test_months_are_pruned(spark, tmp_path):
    path = str(tmp_path / "slots")
    rows = [(i, 1, i, at("12:00").replace(month=1 + i % 6), 7200) for i in range(60)]
    rows += [(60, 1, 60, None, 7200), (61, 1, 61, at("23:30", 30), 7200)]
    write_slots_by_month(frame(spark, "slots", rows), path)
    april = read_slots_between(spark, path, "2026-04-01 00:00:00", "2026-05-01 00:00:00")
    assert april.count() == 11
    # a slot that began in April still overlaps the first hours of May
    assert read_slots_between(spark, path, "2026-05-01 00:00:00", "2026-05-02 00:00:00").count() == 1
    assert read_slots_between(spark, path, "2026-05-01 01:30:00", "2026-05-02 00:00:00").count() == 0
    scan = april._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot_month" in scan
    folders = {f.split("slot_month=")[1].split("/")[0] for f in april.inputFiles() if "slot_month=" in f}
    assert len(folders) == 7
    read = april.select("slot_id", F.input_file_name().alias("f")).select(
        F.regexp_extract("f", "slot_month=([^/]+)", 1).alias("m")).distinct().collect()
    assert [r["m"] for r in read] == ["2026-04"]
    stored = spark.read.parquet(path)
    assert stored.count() == 62


def month_files(path):
    return {
        m.name: sorted((f.name, f.stat().st_mtime_ns) for f in m.iterdir() if f.name.startswith("part-"))
        for m in Path(path).iterdir() if m.name.startswith("slot_month=")}


def stored(spark, path):
    rows = spark.read.schema(TABLES["slots"]).parquet(path).collect()
    assert len({r.slot_id for r in rows}) == len(rows)
    return {r.slot_id: (r.table_id, r.start, r.duration_s) for r in rows}


@pytest.fixture
def months(spark, tmp_path):
    path = str(tmp_path / "slots")
    rows = [(i, i % 3, i, datetime(2026, 1 + i % 4, 1 + i % 25, 12), 3600) for i in range(40)] + [(99, 1, 99, None, 60)]
    write_slots_by_month(frame(spark, "slots", rows), path)
    return path


def test_only_touched_months_are_rewritten(spark, months):
    before, files = stored(spark, months), month_files(months)
    updates = spark.createDataFrame(
        [(0, datetime(2026, 2, 3, 9), 5), (1, datetime(2026, 2, 4, 9), 6), (7777, datetime(2026, 4, 1), 1)],
        "slot_id long, start timestamp_ntz, table_id int")
    deletes = spark.createDataFrame([(5,), (1,), (8888,)], "slot_id long")
    for _ in range(2):  # a dry run changes no file, and says the same twice
        report = {r.slot_month: (r.n_before, r.n_after) for r in change_slots(spark, months, updates, deletes, True).collect()}
        assert report == {"2026-01": (10, 9), "2026-02": (10, 9)} and month_files(months) == files
    report = {r.slot_month: (r.n_before, r.n_after) for r in change_slots(spark, months, updates, deletes).collect()}
    assert report == {"2026-01": (10, 9), "2026-02": (10, 9)}
    want = {k: v for k, v in before.items() if k not in (1, 5)} | {0: (5, datetime(2026, 2, 3, 9), 3600)}
    assert stored(spark, months) == want
    now = month_files(months)
    assert {m for m in files if now[m] != files[m]} == {"slot_month=2026-01", "slot_month=2026-02"}
    # the same change again: same rows
    change_slots(spark, months, updates, deletes)
    assert stored(spark, months) == want


def test_a_month_that_loses_all_rows_and_one_that_is_new(spark, months):
    before = stored(spark, months)
    may = [(i, datetime(2026, 5, 1)) for i in range(2, 40, 4)]  # all of March
    change_slots(spark, months, spark.createDataFrame([*may, (99, datetime(2026, 6, 1))], "slot_id long, start timestamp_ntz"))
    want = before | {i: (before[i][0], start, before[i][2]) for i, start in [*may, (99, datetime(2026, 6, 1))]}
    assert stored(spark, months) == want
    got = read_slots_between(spark, months, "2026-03-01 00:00:00", "2026-04-01 00:00:00")
    assert got.count() == 0
    change_slots(spark, months, deletes=spark.createDataFrame([(i,) for i in range(100)], "slot_id long"))
    assert stored(spark, months) == {}


def test_a_change_that_breaks_a_rule_changes_no_file(spark, months):
    files = month_files(months)
    with pytest.raises(Exception, match="lasts 9000 s"):
        change_slots(spark, months, spark.createDataFrame([(3, 9000)], "slot_id long, duration_s long"))
    assert month_files(months) == files
    assert change_slots(spark, months).count() == 0 and month_files(months) == files


def test_a_batch_is_stored_once(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.createDataFrame([(1, 2), (2, 3)], "booking_id long, party_size int")
    assert read_appended(spark, "bookings", folder).count() == 0
    assert append_once(rows, "bookings", folder, "first") and not append_once(rows, "bookings", folder, "first")
    # a run that broke off before its batch was complete: its rows do not count, and it can be run again
    rows.withColumn("status", F.lit(1)).write.parquet(f"{folder}/bookings/rows/batch=second")
    assert read_appended(spark, "bookings", folder).count() == 2
    assert append_once(rows.filter("booking_id = 2"), "bookings", folder, "second")
    got = sorted(tuple(r) for r in read_appended(spark, "bookings", folder).select("booking_id", "status").collect())
    assert got == [(1, 1), (2, 1), (2, 1)]
    with pytest.raises(Exception, match="lasts"):
        append_once(spark.createDataFrame([(1, 9000)], "slot_id long, duration_s long"), "slots", folder, "x")
    assert read_appended(spark, "slots", folder).count() == 0


def files_met(path, month, column, low, high):
    """Files of a month whose statistics leave room for the range, and all of them."""
    footers = [pq.ParquetFile(f).metadata for f in (Path(path) / f"slot_month={month}").glob("*.parquet")]
    met = 0
    for footer in footers:
        groups = [footer.row_group(i) for i in range(footer.num_row_groups)]
        at = [footer.row_group(0).column(i).path_in_schema for i in range(footer.num_columns)].index(column)
        met += any(g.column(at).statistics.min <= high and g.column(at).statistics.max >= low for g in groups)
    return met, len(footers)


def test_files_by_table_and_time_serve_both_filters(spark, tmp_path):
    """A third of the slots are on one table; table and day alone, and both together, each leave few files."""
    begin = F.lit("2026-04-01 00:00:00").cast("timestamp_ntz")
    slots = spark.range(60_000).select(
        F.col("id").alias("slot_id"),
        F.when(F.col("id") % 3 == 0, 500).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000))).cast("long").alias("table_id"),
        F.col("id").alias("booking_id"),
        (begin + F.make_dt_interval(F.lit(0), F.lit(0), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(43_200)).cast("int"))).alias("start"),
        F.lit(1800).cast("long").alias("duration_s"),
    ).unionByName(spark.createDataFrame([(-1, None, 1, datetime(2026, 4, 1), 60), (-2, 1, 1, None, 60)], TABLES["slots"]))
    path, plain = str(tmp_path / "both"), str(tmp_path / "time")
    write_slots_by_month(slots, path, by_table=True, tasks=64)
    write_slots_by_month(slots, plain)
    day = datetime(2026, 4, 9), datetime(2026, 4, 9, 23, 59)
    for column, low, high in (("table_id", 700, 700), ("start", *day)):
        met, of = files_met(path, "2026-04", column, low, high)
        assert of >= 50 and met <= of / 4, column
    met, of = files_met(plain, "2026-04", "table_id", 700, 700)
    assert met == of
    span = "2026-04-09 00:00:00", "2026-04-10 00:00:00"
    got = read_slots_between(spark, path, *span, tables=(700, 700))
    want = read_slots_between(spark, plain, *span).filter("table_id = 700")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 0
    every = lambda p: spark.read.schema(TABLES["slots"]).parquet(p).drop("slot_month")
    assert every(path).exceptAll(slots).count() == 0 and every(path).count() == 60_002
    # a change keeps the layout
    change_slots(spark, path, every(plain).filter("table_id = 700").select("slot_id", F.lit(60).alias("duration_s")), by_table=True, tasks=64)
    met, of = files_met(path, "2026-04", "table_id", 700, 700)
    assert of >= 50 and met <= of / 4
    assert {r.duration_s for r in every(path).filter("table_id = 700").collect()} == {60}
    write_slots_by_month(slots.limit(0), str(tmp_path / "none"), by_table=True)
