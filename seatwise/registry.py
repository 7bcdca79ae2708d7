"""Every query over the test tables, by name. Each takes (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.functions import columns as C
from seatwise.operators import admission, changes, intervals, joins, keys, rules
from seatwise.oracle import ORACLES
from seatwise.plans import floor, people, service
from seatwise.sources.day_parts import daily_figures, merge_day_parts, read_day_parts, write_day_parts
from seatwise.sources.mapped import SOURCES, MappedModel
from seatwise.sources.schemas import TABLES
from seatwise.sources.tables import (
    MONTH, append_once, append_rows, change_slots, load_model, read_appended, read_slots_between, write_slots_by_month,
)
from seatwise.streaming import live
from seatwise.workspace import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AS_OF = "2024-01-15 12:45:00"


def query(fn: Callable[[MappedModel], DataFrame]) -> Callable[[MappedModel], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, folder: fn(MappedModel(spark, folder))
    return fn


# floor and bookings ---------------------------------------------------------------


@query
def list_tables(m):
    return floor.list_tables(m.dining_tables())


@query
def total_seats(m):
    return floor.total_seats(m.dining_tables())


@query
def tables_with_bookings(m):
    return floor.tables_with_bookings(m.dining_tables(), m.slots(), m.bookings())


@query
def booking_list(m):
    return floor.booking_list(m.bookings(), m.users(), m.slots())


@query
def customer_bookings(m):
    return floor.customer_bookings(m.bookings(), m.users(), m.slots())


@query
def table_availability(m):
    return floor.table_availability(m.table_requests(), m.slots(), m.bookings())


@query
def capacity_usage(m):
    windows = m.hours().select(F.col("at").alias("start"), F.lit(7200).cast("long").alias("duration_s"))
    return floor.capacity_usage(windows, m.slots(), m.bookings(), m.dining_tables())


@query
def overlap_sum_all(m):
    live_rows = intervals.with_bounds(joins.blocking_slots(m.slots(), m.bookings()))
    rows = intervals.overlap_sum(live_rows, live_rows, "party_size", "people")
    return rows.select("slot_id", "people")


@query
def overlap_pairs(m):
    """Requests with the slots in their way. Every tenth asks for ten years, from five before, for which
    its own booking's slots alone are looked up; the rest ask for two hours of a table."""
    long = F.col("request_id") % 10 == 0
    asked = m.table_requests().withColumns({
        "place": F.when(long, -F.col("request_id") - 1).otherwise(F.col("table_id")),
        "start": F.when(long, C.slot_end("start", F.lit(-1826 * 86400))).otherwise(F.col("start")),
        "duration_s": F.when(long, 3652 * 86400).otherwise(F.col("duration_s")).cast("long"),
    }).drop("table_id")
    slots = m.slots().select("slot_id", "start", "duration_s", F.inline(F.array(
        F.struct(F.col("table_id").alias("place")), F.struct((-F.col("booking_id") - 1).alias("place")))))
    pairs = intervals.overlap_join(intervals.with_bounds(asked), intervals.with_bounds(slots), ["place"])
    return pairs.select("request_id", "slot_id", "place")


@query
def upcoming_bookings(m):
    return floor.upcoming_bookings(m.hours(), m.slots(), m.bookings(), m.users())


@query
def table_board(m):
    return floor.table_board(
        m.dining_tables(), m.slots(), m.bookings(), m.users(), m.floor_orders(), AS_OF
    )


@query
def table_board_now(m):
    """The board as of the current time, long after the last slot here."""
    return floor.table_board(
        m.dining_tables(), m.slots(), m.bookings(), m.users(), m.floor_orders()
    )


@query
def seated_customers(m):
    return floor.seated_customers(m.slots(), m.bookings(), m.users(), AS_OF)


@query
def seated_customers_each(m):
    return floor.seated_customers_each(m.hours(), m.slots(), m.bookings(), m.users())


@query
def bookings_by_day(m):
    return floor.bookings_by_period(m.slots(), m.bookings(), "day")


@query
def bookings_by_week(m):
    return floor.bookings_by_period(m.slots(), m.bookings(), "week")


@query
def bookings_by_month(m):
    return floor.bookings_by_period(m.slots(), m.bookings(), "month")


@query
def booking_order_history(m):
    return floor.booking_order_history(m.bookings(), m.users(), m.slots(), m.floor_orders())


# menu, orders, kitchen, sales --------------------------------------------------------


@query
def menu_by_category(m):
    return service.menu_by_category(m.dishes_with_category(), m.categories())


@query
def dishes_in_category(m):
    return service.dishes_in_category(m.dishes_with_category(), m.categories(), "PROMO")


@query
def order_list(m):
    return service.order_list(m.orders(), m.users())


@query
def order_detail(m):
    return service.order_detail(m.orders(), m.order_lines(), m.users(), m.dishes())


@query
def customer_orders(m):
    return service.customer_orders(m.orders(), m.order_lines(), m.users(), m.dishes())


@query
def kitchen_queue(m):
    return service.kitchen_queue(m.order_lines(C.REQUESTED).drop("cook_id"), m.dishes(), m.specialties())


@query
def kitchen_first(m):
    return service.kitchen_first(m.order_lines(C.REQUESTED).drop("cook_id"), m.dishes(), m.specialties(), 5)


@query
def kitchen_next(m):
    """What each cook does next: one row per cook."""
    return service.kitchen_next(m.order_lines(C.REQUESTED), m.dishes(), m.specialties())


@query
def kitchen_panel(m):
    return service.kitchen_panel(
        m.orders(), m.order_lines(C.REQUESTED).drop("cook_id"), m.users(), m.dishes(), m.specialties()
    )


@query
def kitchen_load(m):
    return service.kitchen_load(m.order_lines(C.REQUESTED), m.dishes(), m.specialties())


@query
def ready_lines(m):
    return service.ready_lines(m.orders(), m.order_lines(C.PREPARED), m.users(), m.dishes())


@query
def delivered_lines(m):
    return service.delivered_lines(m.orders(), m.order_lines(C.DELIVERED), m.dishes())


@query
def order_totals(m):
    return service.order_totals(m.order_lines(), m.dishes())


@query
def dish_ranking(m):
    return service.dish_ranking(m.order_lines(), m.dishes())


@query
def top_dishes(m):
    return joins.top_k(
        service.dish_ranking(m.order_lines(), m.dishes()), 10,
        "-total_units", "-times_ordered", "dish", "dish_id",
    )


@query
def sales_by_day(m):
    return service.sales_by_period(m.order_lines(C.DELIVERED), m.dishes(), "day")


@query
def sales_by_week(m):
    return service.sales_by_period(m.order_lines(C.DELIVERED), m.dishes(), "week")


@query
def sales_by_month(m):
    return service.sales_by_period(m.order_lines(C.DELIVERED), m.dishes(), "month")


@query
def daily_kpis(m):
    return service.daily_kpis(m.order_lines(), m.dishes())


@query
def format_amounts(m):
    sales = service.sales_by_period(m.order_lines(C.DELIVERED), m.dishes(), "day")
    return sales.select("day", C.format_amount("total_sales").alias("total_sales"))


# people --------------------------------------------------------------------------------


@query
def staff_by_role(m):
    return people.staff_by_role(m.users(), m.role_assignments(), m.roles())


@query
def user_directory(m):
    return people.user_directory(m.users(), m.role_assignments(), m.roles())


@query
def system_counts(m):
    return people.system_counts(m.users(), m.orders())


@query
def cook_dishes(m):
    return people.cook_dishes(m.specialties(), m.users(), m.dishes())


@query
def pseudonymise(m):
    digest = F.lower(F.hex(C.sha256_digest("login")))
    return m.users().select("user_id", digest.alias("login_digest"))


# rules ---------------------------------------------------------------------------------


@query
def has_role(m):
    return rules.with_role(
        m.users(), "user_id", C.COOK.lower(), "is_cook", m.role_assignments(), m.roles()
    )


@query
def check_bookings(m):
    return rules.check_bookings(m.bookings(), m.role_assignments(), m.roles())


@query
def accepted_bookings(m):
    return rules.accepted(rules.check_bookings(m.bookings(), m.role_assignments(), m.roles()))


@query
def check_orders(m):
    return rules.check_orders(m.orders(), m.role_assignments(), m.roles())


@query
def check_specialties(m):
    return rules.check_specialties(m.specialties(), m.role_assignments(), m.roles())


@query
def check_preparations(m):
    return rules.check_preparations(
        m.claimed_preparations(), None, m.specialties(), m.role_assignments(), m.roles()
    )


@query
def check_preparations_by_line(m):
    return rules.check_preparations(
        m.claimed_lines(), m.lines_with_id(), m.specialties(), m.role_assignments(), m.roles()
    )


@query
def check_slots(m):
    return rules.check_slots(m.proposed_slots(), m.slots(), m.bookings(), m.dining_tables())


@query
def recheck_slots(m):
    """The stored slots judged as if each were saved again: its own row does not count."""
    return rules.check_slots(
        m.slots(), m.slots(), m.bookings(), m.dining_tables(), update=True
    )


@query
def check_columns(m):
    return rules.check_columns(m.unchecked_slots(), "slots")


def _stored(m: MappedModel, *names: str) -> dict[str, DataFrame]:
    """The mapped tables by name, all 12 by default; only the named ones are built."""
    made = {
        "roles": m.roles, "users": m.accounts, "role_assignments": m.role_assignments,
        "dining_tables": m.dining_tables, "categories": m.categories,
        "dishes": m.dishes_with_category, "bookings": m.bookings, "slots": m.slots,
        "orders": m.orders, "order_lines": m.lines_with_id, "specialties": m.specialties,
        "preparations": m.preparations,
    }
    return {name: made[name]() for name in names or made}


@query
def audit_columns(m):
    """Column rules of all tables: how many rows break which rule first."""
    model = {**_stored(m), "slots": m.unchecked_slots()}
    return rules.audit_columns(model)


@query
def audit_fks(m):
    return rules.audit_fks(_stored(m))


@query
def audit_uniques(m):
    return rules.audit_uniques(_stored(m))


@query
def audit_overlaps(m):
    return rules.audit_overlaps(m.slots(), m.bookings(), m.dining_tables())


@query
def audit_overlap_counts(m):
    return rules.overlap_counts(m.slots(), m.bookings())


@query
def audit_capacity(m):
    """Capacity when only a fifth of the seats may be used."""
    fifth = m.dining_tables().agg((F.sum("seats") / 5).cast("long")).scalar()
    return rules.audit_capacity(m.slots(), m.bookings(), m.dining_tables(), fifth)


@query
def audit_repeated_bookings(m):
    return rules.audit_repeated_bookings(m.slots().unionByName(m.proposed_slots()))


@query
def admit_slots(m):
    return admission.admit_slots(
        m.slot_requests(), m.seated_slots(), m.bookings(), m.dining_tables(), ["arrived"]
    ).select("slot_id", "table_id", "booking_id", "rule", "message")


@query
def admit_slots_capacity(m):
    """The batch admitted one by one when only a fifth of the seats may be used at a time."""
    fifth = m.dining_tables().agg((F.sum("seats") / 5).cast("long")).scalar()
    return admission.admit_slots(
        m.slot_requests(), m.seated_slots(), m.bookings(), m.dining_tables(), ["arrived"], total=fifth
    ).select("slot_id", "table_id", "booking_id", "rule", "message")


# changes -------------------------------------------------------------------------------


@query
def assign_ids(m):
    new = m.source("orders").select("o_orderkey", "o_orderdate")
    return keys.assign_ids(new, "order_id", ["o_orderdate", "o_orderkey"], m.orders())


@query
def resolve_names(m):
    name = F.when(F.col("p_size") % 10 == 0, F.col("p_name")).otherwise(F.col("p_type"))
    asked = m.source("part").select(F.col("p_partkey").alias("dish_id"), name.alias("category"))
    resolved, rejected = keys.resolve_names(asked, "category", m.categories(), "name", "category_id")
    return resolved.unionByName(rejected.drop("category"), allowMissingColumns=True)


@query
def split_order_forms(m):
    at = F.lit(AS_OF).cast("timestamp_ntz")
    _, lines, _ = changes.split_order_forms(m.order_forms(), m.orders(), ["form_id"], m.last_line_id(), at)
    return lines


@query
def order_form_tables(m):
    """Forms that bring no table, with the one where their customer sits."""
    forms = m.order_forms().withColumn("table_id", F.lit(None).cast("long"))
    at = F.lit(AS_OF).cast("timestamp_ntz")
    return changes.with_active_table(forms, m.slots(), m.bookings(), at).select("form_id", "customer_id", "table_id")


@query
def order_form_headers(m):
    heads, _, rejected = changes.split_order_forms(m.order_forms(), m.orders(), ["form_id"])
    return heads.unionByName(rejected, allowMissingColumns=True)


@query
def apply_updates(m):
    table, _ = changes.apply_updates(
        m.bookings(), m.booking_changes(), "booking_id", ["status"], ["changed"]
    )
    return table


@query
def changed_rows(m):
    _, changed = changes.apply_updates(
        m.bookings(), m.booking_changes(), "booking_id", ["status"], ["changed"]
    )
    return changed


@query
def apply_deletes(m):
    """Cancelled bookings go, and their slots with them."""
    model = {"bookings": m.bookings(), "slots": m.slots()}
    gone = m.bookings().filter(F.col("status") == C.CANCELLED)
    _, deleted, _ = changes.apply_deletes(model, "bookings", gone)
    return deleted["bookings"].select(F.lit("bookings").alias("table_name"), F.col("booking_id").alias("id")).unionByName(
        deleted["slots"].select(F.lit("slots").alias("table_name"), F.col("slot_id").alias("id"))
    )


@query
def table_changes(m):
    """Tables of 2 get a third seat, and every table is asked to go: those with slots or orders stay."""
    tables = m.dining_tables()
    asked = tables.filter("seats = 2").select("table_id", F.lit(3).alias("seats"), F.lit(1).alias("step"))
    changed, _ = changes.apply_updates(tables, asked, "table_id", ["seats"], ["step"])
    model = {**_stored(m, "slots", "orders"), "dining_tables": changed}
    left, _, _ = changes.apply_deletes(model, "dining_tables", tables)
    return left["dining_tables"]


@query
def refused_deletes(m):
    """Every user asked to be deleted; bookings, orders and preparations keep theirs."""
    model = _stored(m, "users", "role_assignments", "bookings", "slots", "orders", "specialties")
    model["preparations"] = m.unnumbered_preparations()
    _, deleted, refused = changes.apply_deletes(model, "users", m.users())
    done = deleted["users"].select("user_id", F.lit(None).cast("string").alias("blocked_by"))
    return refused.unionByName(done)


@query
def model_scan(m):
    """Stored tables read back with their declared types: people booked per customer."""
    path = new_folder(m.spark, "model")
    for name, rows in _stored(m, "bookings", "users").items():
        rows.write.parquet(f"{path}/{name}")
    model = load_model(m.spark, path, ["bookings", "users"])
    per = model["bookings"].groupBy(F.col("customer_id").alias("user_id")).agg(F.sum("party_size").alias("people"))
    return model["users"].join(per, "user_id").select("user_id", "login", "people")


@query
def append_defaults(m):
    """Bookings appended in two parts, the second without a status: it gets the default."""
    path = new_folder(m.spark, "appended")
    cancelled = F.col("status") == C.CANCELLED
    append_rows(m.bookings().filter(cancelled), "bookings", path)
    append_rows(m.bookings().filter(~cancelled).drop("status"), "bookings", path)
    return load_model(m.spark, path, ["bookings"])["bookings"]


@query
def slots_by_month_pruned(m):
    path = new_folder(m.spark, "slots")
    write_slots_by_month(m.spread_slots(), path)
    return read_slots_between(m.spark, path, "2024-02-05 00:00:00", "2024-02-20 00:00:00")


@query
def slots_by_place_pruned(m):
    """Two days of a quarter of the tables, from files laid out by table and time."""
    path = new_folder(m.spark, "slots")
    write_slots_by_month(m.spread_slots(), path, by_table=True)
    quarter = m.dining_tables().agg((F.count("*") / 4).cast("long")).first()[0]
    return read_slots_between(m.spark, path, "2024-02-05 00:00:00", "2024-02-07 00:00:00", tables=(quarter, 2 * quarter - 1))


@query
def stored_slot_changes(m):
    """Stored slots of which those of released bookings go and those of cancelled ones start a month and an hour later,
    read back from the files."""
    path = new_folder(m.spark, "slots")
    write_slots_by_month(m.spread_slots(), path)
    of = lambda status: m.spread_slots().join(
        m.bookings().filter(F.col("status") == status).select("booking_id"), "booking_id", "left_semi")
    later = F.col("start") + F.make_dt_interval(F.lit(31), F.lit(1))
    change_slots(m.spark, path, of(C.CANCELLED).select("slot_id", later.alias("start")), of(C.RELEASED).select("slot_id"))
    return m.spark.read.schema(TABLES["slots"]).parquet(path).drop(MONTH)


@query
def merged_day_figures(m):
    """Daily figures from stored sums, after three batches of changes in March 1995: first lines are delivered (sent
    twice), second ones deleted, third ones moved by 31 days."""
    home = new_folder(m.spark, "day-parts")
    lines = m.order_lines()
    write_day_parts(lines, home)
    of = lambda no: lines.filter((F.date_format("requested", "yyyy-MM") == "1995-03") & (F.col("line_no") == no))
    later = F.col("requested") + F.make_dt_interval(F.lit(31))
    for _ in range(2):
        merge_day_parts(m.spark, home, of(1), of(1).withColumn("status", F.lit(C.DELIVERED)), "delivered")
    merge_day_parts(m.spark, home, of(2), lines.limit(0), "deleted")
    merge_day_parts(m.spark, home, of(3), of(3).withColumn("requested", later), "moved")
    return daily_figures(read_day_parts(m.spark, home), m.dishes())


@query
def append_batches(m):
    """Bookings appended in two named batches, one of them sent twice: it is stored once."""
    path = new_folder(m.spark, "batches")
    cancelled = F.col("status") == C.CANCELLED
    for batch, rows in (("a", cancelled), ("b", ~cancelled), ("a", cancelled)):
        append_once(m.bookings().filter(rows), "bookings", path, batch)
    return read_appended(m.spark, "bookings", path)


# streams, run until the input is used up -----------------------------------------------


def _stream(m: MappedModel, name: str) -> DataFrame:
    return live.file_stream(m.spark, m.folder, f"{name}.parquet", SOURCES[name])


def _streamed(m: MappedModel, **tables: DataFrame) -> MappedModel:
    """The same mapping with some source tables read as streams."""
    streamed = MappedModel(m.spark, m.folder)
    streamed.source = lambda name: tables.get(name, None) or m.source(name)
    return streamed


@query
def stream_ready_alerts(m):
    out = new_folder(m.spark, "ready")
    lines = _streamed(m, lineitem=_stream(m, "lineitem")).order_lines(C.PREPARED)
    live.stream_ready_alerts(lines, m.orders(), m.users(), m.dishes(), out).awaitTermination()
    return live.read_rows(m.spark, out).drop("batch")


@query
def stream_upcoming_alerts(m):
    out = new_folder(m.spark, "upcoming")
    hour = C.slot_end(F.col("ts").cast("date").cast("timestamp_ntz"), 3600 * F.hour("ts"))
    ticks = _stream(m, "events").select(hour.alias("at"))
    live.stream_upcoming_alerts(ticks, m.slots(), m.bookings(), m.users(), out).awaitTermination()
    return live.upcoming_alerts(m.spark, out)


@query
def stream_table_board(m):
    out = new_folder(m.spark, "board")
    ticks = _stream(m, "events").select(F.col("ts").alias("at"))
    live.stream_table_board(
        ticks, m.dining_tables(), m.slots(), m.bookings(), m.users(), m.floor_orders(), out
    ).awaitTermination()
    return live.read_rows(m.spark, out).drop("batch")


@query
def stream_floor_board(m):
    """The board as of the last event, from a stream of slots and a stream of orders."""
    out = new_folder(m.spark, "floor")
    slots = _streamed(m, events=_stream(m, "events")).slots()
    customers = m.bookings().select("booking_id", "customer_id")
    orders = _streamed(m, events=_stream(m, "events")).floor_orders()
    live.stream_floor_changes(slots.join(customers, "booking_id", "left"), orders, out).awaitTermination()
    at = m.slots().select(F.col("start").alias("at")).unionByName(m.floor_orders().select(F.col("placed").alias("at")))
    last = at.agg(F.max("at")).first()[0]
    return live.floor_board(m.spark, out, m.dining_tables(), m.users(), last).withColumn("at", floor.instant(last))


@query
def stream_live_board(m):
    out = new_folder(m.spark, "live")
    events = _streamed(m, events=_stream(m, "events")).slots()
    live.stream_live_board(
        events, "table_id", ["booking_id", "duration_s"], ["start", "slot_id"], out
    ).awaitTermination()
    return live.live_board(m.spark, out, "table_id")


@query
def stream_daily_sales(m):
    out = new_folder(m.spark, "sales")
    lines = _streamed(m, lineitem=_stream(m, "lineitem")).order_lines(C.DELIVERED)
    live.stream_daily_sales(lines, m.dishes(), out).awaitTermination()
    return live.daily_sales(m.spark, out)


@query
def stream_closed_days(m):
    out = new_folder(m.spark, "closed")
    lines = _streamed(m, lineitem=_stream(m, "lineitem")).order_lines(C.DELIVERED)
    live.stream_closed_days(lines, m.dishes(), out).awaitTermination()
    return live.closed_days(m.spark, out)


@query
def stream_day_parts(m):
    out = new_folder(m.spark, "parts")
    lines = _streamed(m, lineitem=_stream(m, "lineitem")).order_lines(C.DELIVERED)
    live.stream_day_parts(lines, m.dishes(), out).awaitTermination()
    return live.sales_so_far(m.spark, out)


@query
def stream_upcoming_once(m):
    """Every booking announced once, however many hours of the clock see it coming."""
    out = new_folder(m.spark, "upcoming")
    hour = C.slot_end(F.col("ts").cast("date").cast("timestamp_ntz"), 3600 * F.hour("ts"))
    ticks = _stream(m, "events").select(hour.alias("at"))
    live.stream_upcoming_alerts(ticks, m.slots(), m.bookings(), m.users(), f"{out}/all", 7200).awaitTermination()
    live.stream_upcoming_once(m.spark, f"{out}/all", f"{out}/once", 7200).awaitTermination()
    return live.read_rows(m.spark, f"{out}/once").select("booking_id", "customer", "table_id", "start", "end")
