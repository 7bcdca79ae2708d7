"""Streams against the batch answer, over several files and a restart."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from seatwise.plans import floor, service
from seatwise.streaming import live
from tests.seed import at, frame

LINES = "line_id long, dish_id long, order_id long, status int, qty int, requested timestamp_ntz"


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def feed(df, folder, name):
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_ready_alerts_resume(spark, seed, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        lines = spark.readStream.schema(seed["order_lines"].schema).parquet(f"{source}/lines")
        live.stream_ready_alerts(
            lines, seed["orders"], seed["users"], seed["dishes"], out).awaitTermination()
        return as_set(live.read_rows(spark, out), "order_id", "table_id", "message")

    feed(seed["order_lines"].filter("line_id <= 5"), source, "lines")
    assert run() == {(2, 4, "Order 2 waits at the pass for Person 04")}
    feed(seed["order_lines"].filter("line_id > 5"), source, "lines")
    assert {r[:2] for r in run()} == {(2, 4), (4, 5), (6, 9)}
    assert live.read_rows(spark, out).count() == 3


def test_upcoming_and_board(spark, seed, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "at timestamp_ntz"
    feed(spark.createDataFrame([(at("13:40"),), (at("14:45"),)], schema), source, "ticks")
    feed(spark.createDataFrame([(at("14:45"),), (at("15:00"),)], schema), source, "ticks")
    ticks = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/ticks")
    args = seed["slots"], seed["bookings"], seed["users"]
    live.stream_upcoming_alerts(ticks(), *args, out=f"{out}/u").awaitTermination()
    refs = spark.createDataFrame([(at(c),) for c in ("13:40", "14:45", "15:00")], schema)
    got = as_set(live.upcoming_alerts(spark, f"{out}/u"), "at", "booking_id")
    assert got == as_set(floor.upcoming_bookings(refs, *args), "at", "booking_id")
    assert got == {(at("13:40"), 7), (at("14:45"), 8), (at("15:00"), 8)}

    orders = seed["orders"].withColumn("placed", F.lit(str(at("12:00"))).cast("timestamp_ntz"))
    live.stream_table_board(
        ticks(), seed["dining_tables"], *args, orders, f"{out}/b").awaitTermination()
    rows = live.read_rows(spark, f"{out}/b")
    assert rows.groupBy("batch").count().filter("count = 15").count() == 2
    last = rows.filter(F.col("at") == F.lit(str(at("15:00"))).cast("timestamp_ntz"))
    want = floor.table_board(seed["dining_tables"], *args, orders, at("15:00"))
    assert as_set(last, "table_id", "state", "customer") == as_set(want, "table_id", "state", "customer")


def test_live_board_keeps_the_latest_across_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "line_id long, ts timestamp_ntz, id long, status int"

    def run(rows):
        feed(spark.createDataFrame(rows, schema), source, "ev")
        events = spark.readStream.schema(schema).parquet(f"{source}/ev")
        live.stream_live_board(events, "line_id", ["status"], ["ts", "id"], out).awaitTermination()
        return as_set(live.live_board(spark, out, "line_id"), "line_id", "status")

    assert run([(1, at("12:00"), 1, 1), (1, at("12:05"), 2, 2), (2, at("12:00"), 3, 1)]) == {(1, 2), (2, 1)}
    # an event older than the kept state does not win; equal times go by id
    assert run([(1, at("11:00"), 4, 1), (2, at("12:00"), 5, 3), (3, at("12:00"), 6, 1)]) == {(1, 2), (2, 3), (3, 1)}


def test_batches_without_rows_write_nothing(spark, seed, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark.createDataFrame([(at("13:40"),), (None,)], "at timestamp_ntz"), source, "ticks")
    feed(seed["order_lines"], source, "lines")
    none = spark.readStream.schema("at timestamp_ntz").parquet(f"{source}/ticks").filter("at > timestamp_ntz'2030-01-01'")
    args = seed["slots"], seed["bookings"], seed["users"]
    orders = seed["orders"].withColumn("placed", F.lit(str(at("12:00"))).cast("timestamp_ntz"))
    live.stream_table_board(none, seed["dining_tables"], *args, orders, f"{out}/b").awaitTermination()
    live.stream_upcoming_alerts(none, *args, out=f"{out}/u").awaitTermination()
    lines = spark.readStream.schema(seed["order_lines"].schema).parquet(f"{source}/lines").filter("line_id < 0")
    live.stream_ready_alerts(lines, seed["orders"], seed["users"], seed["dishes"], f"{out}/r").awaitTermination()
    assert not any((tmp_path / "out" / name / "rows").exists() for name in "bur")


def test_compaction_keeps_the_board(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k long, ts timestamp_ntz, v int"
    for minute in range(4):
        feed(spark.createDataFrame([(minute % 2, at(f"12:{minute:02d}"), minute), (9, at("12:00"), 9)], schema), source, "ev")
        events = spark.readStream.schema(schema).parquet(f"{source}/ev")
        live.stream_live_board(events, "k", ["v"], ["ts"], out).awaitTermination()
    board = lambda: as_set(live.live_board(spark, out, "k"), "k", "v")
    before = board()
    live.compact_board(spark, out, "k")
    assert board() == before == {(0, 2), (1, 3), (9, 9)}
    # one row per key is left, under the batch that wrote it
    assert live.read_rows(spark, out).count() == 3
    # a compaction that broke off has either part missing
    rows = tmp_path / "out" / "rows"
    rows.rename(tmp_path / "aside")
    assert board() == before
    (tmp_path / "aside").rename(rows)
    (tmp_path / "out" / "folded").rename(tmp_path / "aside")
    assert board() == before
    feed(spark.createDataFrame([(0, at("13:00"), 7), (4, at("13:00"), 8)], schema), source, "ev")
    live.stream_live_board(spark.readStream.schema(schema).parquet(f"{source}/ev"), "k", ["v"], ["ts"], out).awaitTermination()
    assert board() == {(0, 7), (1, 3), (4, 8), (9, 9)}
    live.compact_board(spark, out, "k")
    assert board() == {(0, 7), (1, 3), (4, 8), (9, 9)} and live.read_rows(spark, out).count() == 4


def test_daily_sales_count_late_rows_and_open_days(spark, seed, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    days = [20, 5, 6, 20, 5]
    for i, day in enumerate(days):
        rows = [(i, 12, 1, 3, 1 + i, datetime(2026, 4, day, 12, 0)), (50 + i, 12, 1, 1, 7, datetime(2026, 4, day))]
        feed(spark.createDataFrame(rows, LINES), source, "lines")
    lines = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(f"{source}/lines")
    live.stream_daily_sales(lines, seed["dishes"], out).awaitTermination()
    got = as_set(live.daily_sales(spark, out), "day", "total_sales", "n_lines")
    want = {(date(2026, 4, 20), Decimal(35000), 2), (date(2026, 4, 5), Decimal(49000), 2), (date(2026, 4, 6), Decimal(21000), 1)}
    assert got == want
    # only the last two states are kept, and a later run goes on from there
    assert len(list((tmp_path / "out" / "rows").glob("turn=*"))) == 2
    feed(spark.createDataFrame([(9, 12, 1, 3, 1, datetime(2026, 4, 1, 0, 0))], LINES), source, "lines")
    again = spark.readStream.schema(LINES).parquet(f"{source}/lines")
    live.stream_daily_sales(again, seed["dishes"], out).awaitTermination()
    assert as_set(live.daily_sales(spark, out), "day", "total_sales", "n_lines") == want | {(date(2026, 4, 1), Decimal(7000), 1)}


def test_shuffled_files_equal_batch(spark, seed, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    lines = spark.range(400).select(
        F.col("id").alias("line_id"), (1 + F.col("id") % 14).alias("dish_id"), F.lit(1).cast("long").alias("order_id"),
        (1 + F.col("id") % 3).cast("int").alias("status"), F.lit(2).alias("qty"),
        (F.lit(str(at("00:00", 1))).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("id") * 3).cast("int"))).alias("requested"))
    lines.repartition(6).write.parquet(f"{source}/lines")
    stream = live.file_stream(spark, f"{source}/lines", "*.parquet", lines.schema, maxFilesPerTrigger="1")
    live.stream_daily_sales(stream, seed["dishes"], out).awaitTermination()
    got = as_set(live.daily_sales(spark, out), "day", "total_sales")
    assert got == as_set(service.sales_by_period(lines, seed["dishes"], "day"), "day", "total_sales")


def sold(i, day, hour=12, dish=12, status=3, qty=1):
    return (i, dish, 1, status, qty, datetime(2026, 4, day, hour))


def test_closed_days_and_corrections_are_the_batch_totals(spark, seed, tmp_path):
    """Several shuffled files: each day is written once, late lines are corrections, and state forgets closed days."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    files = [
        [sold(1, 5), sold(2, 5, 23, dish=14), sold(3, 6, status=1)], [sold(4, 6), sold(5, 9)],
        [sold(6, 5, 1, qty=4), sold(7, 12)],  # day 5 is closed by now
        [sold(8, 12, 0), sold(9, 13), sold(10, 9, qty=2)], [sold(11, 18)], [sold(12, 7)],  # a day that was never seen
    ]
    every = spark.createDataFrame([r for f in files for r in f], LINES)
    for i, rows in enumerate(files):
        feed(spark.createDataFrame(rows, LINES), source, "lines")
        for name, start in (("closed", live.stream_closed_days), ("parts", live.stream_day_parts)):
            lines = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(f"{source}/lines")
            query = start(lines, seed["dishes"], f"{out}/{name}")
            query.awaitTermination()
            if name == "closed":
                progress = [p for p in query.recentProgress if p["stateOperators"]]
                # a row per open day and dish: two days with a dish each at most
                assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2
    closed = live.closed_days(spark, f"{out}/closed")
    days = [r.day for r in closed.collect()]
    assert len(days) == len(set(days)) and date(2026, 4, 18) not in days and date(2026, 4, 13) in days
    corrections = live.day_corrections(spark, f"{out}/closed", f"{out}/parts")
    assert {(r.day, r.n_lines) for r in corrections.collect()} == {(date(2026, 4, d), 1) for d in (5, 7, 9)}
    total = closed.unionByName(corrections).groupBy("day").agg(
        F.sum("total_sales").alias("total_sales"), F.sum("n_lines").alias("n_lines"))
    want = service.sales_by_period(every, seed["dishes"], "day").filter("day < date'2026-04-18'")
    assert as_set(total, "day", "total_sales") == as_set(want, "day", "total_sales")
    so_far = live.sales_so_far(spark, f"{out}/parts")
    assert as_set(so_far, "day", "total_sales") == as_set(service.sales_by_period(every, seed["dishes"], "day"), "day", "total_sales")


def test_an_alert_comes_once_over_batches_and_restarts(spark, seed, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    args = seed["slots"], seed["bookings"], seed["users"]

    def tick(*clocks):
        feed(spark.createDataFrame([(at(c),) for c in clocks], "at timestamp_ntz"), source, "ticks")
        ticks = spark.readStream.schema("at timestamp_ntz").parquet(f"{source}/ticks")
        live.stream_upcoming_alerts(ticks, *args, out=f"{out}/all").awaitTermination()
        live.stream_upcoming_once(spark, f"{out}/all", f"{out}/once").awaitTermination()
        rows = [tuple(r) for r in live.read_rows(spark, f"{out}/once").select("at", "booking_id").collect()]
        return sorted(rows)

    assert tick("13:40") == [(at("13:40"), 7)]
    assert tick("13:40", "13:45") == [(at("13:40"), 7)]  # the same tick again, and a later one
    assert tick("14:45", "14:45") == [(at("13:40"), 7), (at("14:45"), 8)]
    assert tick("15:00") == [(at("13:40"), 7), (at("14:45"), 8)]
    # readers of all alerts see more rows than there are bookings
    assert live.read_rows(spark, f"{out}/all").count() > 2


SLOT = "slot_id long, table_id long, booking_id long, customer_id long, start timestamp_ntz, duration_s long"


def test_floor_board_of_two_streams_equals_the_batch_board(spark, tmp_path):
    """Slots and orders arrive in files of their own, out of order within half an hour: after each pair of files the board is
    that of all rows so far, and the state forgets slots that are over and orders of days that are."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rng = random.Random(5)
    begin = datetime(2026, 4, 5, 19, 0)
    tables = spark.createDataFrame([(t, 4) for t in range(8)], "table_id long, seats int")
    users = spark.createDataFrame([(c, f"Person {c:02d}") for c in range(11)], "user_id long, name string")
    slots, orders, widest = [], [], 0
    for batch in range(9):
        now = begin + timedelta(hours=batch * 5)  # three days, with slots over midnight
        new_slots = [(100 * batch + i, rng.randrange(8), 100 * batch + i, rng.choice([None, *range(12)]),
                      now + timedelta(minutes=rng.randrange(-20, 40)), rng.choice([1800, 3600, 7200])) for i in range(9)]
        new_orders = [(rng.randrange(12), now + timedelta(minutes=rng.randrange(-20, 40))) for _ in range(7)]
        new_orders += new_orders[:2] + [(None, now), (1, None)]
        slots, orders = slots + new_slots, orders + new_orders
        feed(spark.createDataFrame(new_slots, SLOT), source, "slots")
        feed(spark.createDataFrame(new_orders, "customer_id long, placed timestamp_ntz"), source, "orders")
        stream = lambda name, schema: spark.readStream.schema(schema).parquet(f"{source}/{name}")
        query = live.stream_floor_changes(
            stream("slots", SLOT), stream("orders", "customer_id long, placed timestamp_ntz"), out)
        query.awaitTermination()
        held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
        widest = max(widest, held[-1])
        at_end = max([r[4] for r in slots] + [r[1] for r in orders if r[1]])
        every = spark.createDataFrame(slots, SLOT)
        bookings = every.filter("customer_id IS NOT NULL").select("booking_id", "customer_id", F.lit(1).alias("status"))
        want = floor.table_board(
            tables, every.drop("customer_id"), bookings, users,
            spark.createDataFrame(orders, "customer_id long, placed timestamp_ntz"), at_end)
        got = live.floor_board(spark, out, tables, users, at_end)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), batch
    states = {r.state for r in live.floor_board(spark, out, tables, users, at_end).collect()}
    assert states == {"Occupied", "Reserved", "Free"}
    # 81 slots and 81 orders came; a batch's slots, and the orders of a day with their first sight of each customer, are held
    assert widest <= 9 * 2 + 2 * 7 * 5 and held[-1] < len(slots)
    # a reader opens the folders of the day and, after midnight only, of the one before
    plan = live.floor_board(spark, out, tables, users, "2026-04-06 20:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "(day#" in plan


def test_floor_changes_of_a_repeated_batch_replace_themselves(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark.createDataFrame([(1, 1, 1, 5, at("12:00"), 3600)], SLOT), source, "slots")
    feed(spark.createDataFrame([(5, at("12:05"))], "customer_id long, placed timestamp_ntz"), source, "orders")

    def run():
        live.stream_floor_changes(
            spark.readStream.schema(SLOT).parquet(f"{source}/slots"),
            spark.readStream.schema("customer_id long, placed timestamp_ntz").parquet(f"{source}/orders"), out,
        ).awaitTermination()
        return live.read_rows(spark, out).count()

    assert run() == 2
    # the batch is taken for not committed, as after a failure, and runs again
    commit = max((tmp_path / "out" / "_progress" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    commit.rename(tmp_path / "commit")
    crc = commit.with_name(f".{commit.name}.crc")
    if crc.exists():
        crc.rename(tmp_path / "commit.crc")
    assert run() == 2
