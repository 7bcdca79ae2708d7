"""Named queries on the seed rows, with expected answers worked out by hand."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from seatwise.functions import columns as C
from seatwise.plans import floor, people, service
from tests.seed import at


def rows(df):
    return [tuple(r) for r in df.collect()]


def requests(spark, *rows_):
    return spark.createDataFrame(list(rows_), "table_id long, start timestamp_ntz, duration_s long")


def test_tables(seed):
    assert rows(floor.total_seats(seed["dining_tables"])) == [(60,)]
    listed = rows(floor.list_tables(seed["dining_tables"]))
    assert listed[0] == (1, 2) and len(listed) == 15
    listed = floor.tables_with_bookings(seed["dining_tables"], seed["slots"], seed["bookings"])
    listed = rows(listed)
    assert len(listed) == 15
    assert sum(r[4] is not None for r in listed) == 9
    assert listed[0] == (1, 2, at("11:30"), at("13:30"), 1, 2)
    assert [r[0] for r in listed] == list(range(1, 16))


def test_booking_list_puts_bookings_without_slot_last(seed):
    listed = rows(floor.booking_list(seed["bookings"], seed["users"], seed["slots"]))
    assert len(listed) == 10
    assert listed[0][0] == 9 and listed[0][3] == "released"
    assert listed[-1] == (10, "Person 26", 3, "cancelled", None, None, None, None)


def test_spanish_labels(spark, seed):
    args = seed["bookings"], seed["users"], seed["slots"]
    assert rows(floor.booking_list(*args, C.BOOKING_STATUS_ES))[-1][3] == "cancelada"
    asked = requests(spark, (4, at("13:30"), 7200))
    found = floor.table_availability(asked, seed["slots"], seed["bookings"], C.AVAILABILITY_ES)
    assert found.first()["availability"] == "NO DISPONIBLE"
    detail = service.order_detail(
        seed["orders"], seed["order_lines"], seed["users"], seed["dishes"], C.LINE_STATUS_ES)
    assert {r["status"] for r in detail.collect()} == {"solicitado", "preparado", "entregado"}


def test_customer_history(seed):
    assert rows(floor.customer_bookings(seed["bookings"], seed["users"], seed["slots"], 17)) == [
        (17, "Person 17", 1, 2, "occupied", 1, at("11:30"))
    ]
    lines = rows(service.customer_orders(
        seed["orders"], seed["order_lines"], seed["users"], seed["dishes"], 17))
    assert [(r[5], r[7]) for r in lines] == [("Dish 04", "delivered"), ("Dish 12", "delivered")]


@pytest.mark.parametrize("table,clock,answer", [
    (4, "16:00", "AVAILABLE"), (4, "13:30", "NOT AVAILABLE"), (4, "14:00", "AVAILABLE"),
    (4, "10:00", "AVAILABLE"), (14, "09:30", "NOT AVAILABLE"), (15, "12:00", "AVAILABLE"),
])
def test_availability(spark, seed, table, clock, answer):
    asked = requests(spark, (table, at(clock), 7200))
    found = rows(floor.table_availability(asked, seed["slots"], seed["bookings"]))
    assert [r[-1] for r in found] == [answer]


def test_capacity_windows(spark, seed):
    windows = requests(
        spark, (0, at("13:00"), 7200), (0, at("13:30"), 7200), (0, at("20:00"), 7200)
    ).drop("table_id")
    found = floor.capacity_usage(windows, seed["slots"], seed["bookings"], seed["dining_tables"])
    assert sorted((r[0], r[3], r[4]) for r in rows(found)) == [
        (at("13:00"), 29, 60), (at("13:30"), 29, 60), (at("20:00"), 0, 60)
    ]


def test_upcoming(spark, seed):
    def upcoming(clock):
        refs = spark.createDataFrame([(at(clock),)], "at timestamp_ntz")
        return [r[1] for r in rows(floor.upcoming_bookings(
            refs, seed["slots"], seed["bookings"], seed["users"]))]

    assert upcoming("12:45") == []
    assert upcoming("13:30") == [7]     # starts exactly 30 minutes later
    assert upcoming("14:00") == [7]     # starts now
    assert upcoming("13:29") == []
    assert upcoming("14:45") == [8]


def test_board_and_seated(seed):
    orders = seed["orders"].join(
        seed["order_lines"].groupBy("order_id").agg(F.min("requested").alias("placed")), "order_id"
    )
    board = {r[0]: r[2:] for r in rows(floor.table_board(
        seed["dining_tables"], seed["slots"], seed["bookings"], seed["users"], orders, at("15:00")))}
    assert board[5] == ("Occupied", "Person 20")    # its slot ends exactly then
    assert board[7] == ("Reserved", "Person 23")
    assert board[10] == ("Reserved", "Person 24")
    assert board[1] == ("Free", None)
    assert len(board) == 15
    seated = rows(floor.seated_customers(seed["slots"], seed["bookings"], seed["users"], at("12:15")))
    assert [r[0] for r in seated] == [17, 18]


def test_menu(seed):
    menu = rows(service.menu_by_category(seed["dishes"], seed["categories"]))
    assert [r[1] for r in menu] == ["BEBIDA"] * 3 + ["ENTRADA"] * 3 + ["PLATO FUERTE"] * 6 + ["POSTRE"] * 2
    assert [r[-1] for r in menu if r[-1]] == ["BEBIDA", "ENTRADA", "PLATO FUERTE", "POSTRE"]
    page = rows(service.menu_by_category(seed["dishes"], seed["categories"], "category_id"))
    assert page[0][:3] == (1, "ENTRADA", 1) and page[0][-1] == "ENTRADA"
    mains = rows(service.dishes_in_category(seed["dishes"], seed["categories"], "PLATO FUERTE"))
    assert [r[0] for r in mains] == [4, 5, 6, 7, 8, 9]


def test_orders_and_kitchen(seed):
    assert rows(service.order_list(seed["orders"], seed["users"]))[0] == (1, "Person 17", "Person 03", 1)
    detail = rows(service.order_detail(
        seed["orders"], seed["order_lines"], seed["users"], seed["dishes"]))
    assert len(detail) == 12 and detail[4][:8] == (
        3, "Person 19", "Person 05", 8, 5, "Dish 09", 2, "requested")
    queue = lambda cook=None: rows(service.kitchen_queue(
        seed["order_lines"], seed["dishes"], seed["specialties"], cook))
    assert queue(9) == []
    assert [(r[0], r[2]) for r in queue()] == [(10, 9), (11, 7), (12, 5), (15, 10)]
    first = lambda k: rows(service.kitchen_first(seed["order_lines"], seed["dishes"], seed["specialties"], k))
    assert [(r[0], r[1], r[3]) for r in first(2)] == [(10, 1, 9), (11, 1, 7), (12, 1, 5), (15, 1, 10)] and first(0) == []
    panel = rows(service.kitchen_panel(
        seed["orders"], seed["order_lines"], seed["users"], seed["dishes"], seed["specialties"]))
    assert [r[1] for r in panel] == [5, 7, 9, 10]
    load = rows(service.kitchen_load(seed["order_lines"], seed["dishes"], seed["specialties"]))
    assert load == [(10, 1, 1, 1800), (11, 1, 1, 2100), (12, 1, 2, 1920), (15, 1, 4, 300)]
    ready = rows(service.ready_lines(
        seed["orders"], seed["order_lines"], seed["users"], seed["dishes"]))
    assert [(r[3], r[1]) for r in ready] == [(3, 4), (8, 5), (11, 9)]
    done = rows(service.delivered_lines(seed["orders"], seed["order_lines"], seed["dishes"]))
    assert [r[0] for r in done] == [1, 2, 4, 6, 12]


@pytest.mark.parametrize("unit,first", [
    ("day", date(2026, 4, 13)), ("week", date(2026, 4, 13)), ("month", date(2026, 4, 1))])
def test_periods(seed, unit, first):
    assert rows(floor.bookings_by_period(seed["slots"], seed["bookings"], unit)) == [(first, 9, 37)]
    assert rows(service.sales_by_period(seed["order_lines"], seed["dishes"], unit)) == [
        (first, Decimal("100000.00"))
    ]


def test_ranking_and_day_figures(seed):
    ranking = rows(service.dish_ranking(seed["order_lines"], seed["dishes"]))
    assert ranking[0] == (12, "Dish 12", 6, 2)
    assert ranking[1] == (14, "Dish 14", 3, 1)
    kpis = rows(service.daily_kpis(seed["order_lines"], seed["dishes"]))
    assert kpis == [(date(2026, 4, 13), 6, "Dish 12", 2, Decimal("325000.00"))]
    assert rows(service.daily_kpis(seed["order_lines"], seed["dishes"], "2026-04-14")) == []


def test_people(seed):
    staff = rows(people.staff_by_role(seed["users"], seed["role_assignments"], seed["roles"]))
    assert len(staff) == 16 and staff[0][0] == "ADMIN"
    everyone = people.user_directory(seed["users"], seed["role_assignments"], seed["roles"])
    assert everyone.columns == ["user_id", "name", "login", "role"] and everyone.count() == 28
    assert rows(people.system_counts(seed["users"], seed["orders"])) == [(28, 6)]
    assert len(rows(people.cook_dishes(seed["specialties"], seed["users"], seed["dishes"]))) == 16


def test_history_keeps_bookings_without_orders(seed):
    orders = seed["orders"].join(
        seed["order_lines"].groupBy("order_id").agg(
            F.min("requested").cast("timestamp_ntz").alias("placed")), "order_id"
    )
    history = rows(floor.booking_order_history(
        seed["bookings"], seed["users"], seed["slots"], orders))
    assert [r[0] for r in history] == list(range(10, 0, -1))
    assert {r[0]: r[4] for r in history} == {b: b if b <= 6 else None for b in range(1, 11)}


def test_columns(spark):
    df = spark.createDataFrame(
        [(1, Decimal("325000.00")), (9, Decimal("2.50")), (4, Decimal("1234567.49"))],
        "code int, amount decimal(12,2)",
    )
    got = rows(df.select(
        C.decode_status("code", C.BOOKING_STATUS), C.format_amount("amount")))
    assert got == [("reserved", "325.000"), (None, "3"), ("cancelled", "1.234.567")]
    digest = spark.range(1).select(F.lower(F.hex(C.sha256_digest(F.lit("abc"))))).first()[0]
    assert digest == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    text = spark.range(1).select(C.ready_text(F.lit(3), F.lit("Ann"))).first()[0]
    assert text == "Order 3 waits at the pass for Ann"


@pytest.mark.parametrize("zone", ["America/Bogota", "UTC", "Europe/Madrid"])
def test_epoch_does_not_depend_on_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 02:30:00.000001' AS t")
        got = df.select(
            C.epoch_us("t"), F.unix_micros(C.wall_clock_as_utc("t")),
            C.period("t", "week").cast("string"),
        ).first()
        assert tuple(got) == (1711852200000001, 1711852200000001, "2024-03-25")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
