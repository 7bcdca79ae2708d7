"""The star-schema test tables seen as the reservations model.

Each method is a lazy mapping over a whole table. Only the columns a query uses are
read, because the mappings are plain projections that Catalyst prunes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.functions import columns as C
from seatwise.operators.keys import assign_ids, resolve_names


SOURCES = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
              "props string",
}


class MappedModel:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._categories: DataFrame | None = None
        self._lines: DataFrame | None = None

    def source(self, name: str) -> DataFrame:
        """Typed scan; the declared schema saves a look at the files for every query."""
        return self.spark.read.schema(SOURCES[name]).parquet(f"{self.folder}/{name}.parquet")

    # people -----------------------------------------------------------------
    def users(self) -> DataFrame:
        return self.source("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("name"),
            F.lower("c_name").alias("login"),
        )

    def accounts(self) -> DataFrame:
        """Users with all declared columns; the digest is that of the login."""
        return self.users().select(
            "user_id", "name", C.sha256_digest("login").alias("password_digest"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("digest_ts"), "login",
            F.lit(None).cast("string").alias("token"),
        )

    def roles(self) -> DataFrame:
        names = [C.ADMIN, C.MAITRE, C.WAITER, C.COOK, C.CUSTOMER]
        rows = ", ".join(f"({i}L, '{name}')" for i, name in enumerate(names, 1))
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS roles(role_id, name)")

    def role_assignments(self) -> DataFrame:
        return self.source("customer").select(
            (F.least(F.col("c_custkey") % 10, F.lit(4)) + 1).alias("role_id"),
            F.col("c_custkey").alias("user_id"),
        )

    # floor --------------------------------------------------------------------
    def dining_tables(self) -> DataFrame:
        return self.source("supplier").select(
            F.col("s_suppkey").alias("table_id"),
            (2 + 2 * (F.col("s_suppkey") % 4)).cast("int").alias("seats"),
        )

    def n_tables(self) -> Column:
        return self.source("supplier").agg(F.count("*")).scalar()

    def _events(self) -> DataFrame:
        return self.source("events").withColumn(
            "k", F.regexp_extract("props", "[0-9]+", 0).cast("long")
        )

    def bookings(self) -> DataFrame:
        kind = F.col("event_type")
        status = (
            F.when(kind == "purchase", C.OCCUPIED)
            .when(kind == "view", C.RELEASED)
            .when(kind == "error", C.CANCELLED)
            .otherwise(C.RESERVED)
        )
        party = 1 + F.round(F.col("value") * 100).cast("long") % 8
        return self.source("events").select(
            F.col("event_id").alias("booking_id"),
            F.col("user_id").alias("customer_id"),
            party.cast("int").alias("party_size"),
            status.alias("status"),
        )

    def slots(self) -> DataFrame:
        return self._events().select(
            F.col("event_id").alias("slot_id"),
            ((F.col("user_id") + 13 * F.col("k")) % self.n_tables()).alias("table_id"),
            F.col("event_id").alias("booking_id"),
            F.col("ts").alias("start"),
            (1800 * (1 + F.col("event_id") % 4)).alias("duration_s"),
        )

    def slot_requests(self) -> DataFrame:
        """Slots of bookings that are not yet seated, in the order of ``arrived``."""
        rows = self.source("events").filter(F.col("event_type") != "purchase").select(
            F.col("event_id").alias("slot_id"),
            F.round(F.col("value") * 100).cast("long").alias("arrived"),
        )
        return self.slots().join(rows, "slot_id")

    def seated_slots(self) -> DataFrame:
        seated = self.bookings().filter(F.col("status") == C.OCCUPIED).select("booking_id")
        return self.slots().join(seated, "booking_id", "left_semi")

    def spread_slots(self) -> DataFrame:
        """Slots moved over three months."""
        days = (31 * (F.col("slot_id") % 3)).cast("int")
        zero = F.lit(0)
        return self.slots().withColumn(
            "start", F.col("start") + F.make_dt_interval(days, zero, zero, zero)
        )

    def unchecked_slots(self) -> DataFrame:
        """Slots as a form might send them: the duration can be zero or too long."""
        return self.slots().withColumn("duration_s", 1800 * (F.col("slot_id") % 6))

    def proposed_slots(self) -> DataFrame:
        """A new slot asked for every booking, some for bookings or tables that
        do not exist, some with no duration or too long a one."""
        return self._events().select(
            (F.col("event_id") + 1_000_000_000).alias("slot_id"),
            ((F.col("user_id") * 7 + F.col("k")) % (self.n_tables() + 1)).alias("table_id"),
            (F.col("event_id") * 2).alias("booking_id"),
            C.slot_end("ts", F.lit(1800)).alias("start"),
            (1800 * (F.col("k") % 6)).alias("duration_s"),
        )

    def table_requests(self) -> DataFrame:
        """One availability question per event: is a table free for two hours?"""
        return self._events().select(
            F.col("event_id").alias("request_id"),
            ((F.col("user_id") * 3 + F.col("k")) % self.n_tables()).alias("table_id"),
            C.slot_end("ts", F.lit(3600)).alias("start"),
            F.lit(C.MAX_DURATION_S).cast("long").alias("duration_s"),
        )

    def hours(self) -> DataFrame:
        """Every full hour in which a slot starts."""
        hour = F.col("start").cast("date").cast("timestamp_ntz")
        hour = C.slot_end(hour, 3600 * F.hour("start"))
        return self.slots().select(hour.alias("at")).distinct()

    def floor_orders(self) -> DataFrame:
        return self._events().filter(F.col("event_type") == "purchase").select(
            F.col("event_id").alias("order_id"),
            F.col("user_id").alias("customer_id"),
            ((F.col("user_id") + 13 * F.col("k")) % self.n_tables()).alias("table_id"),
            C.slot_end("ts", F.lit(600)).alias("placed"),
        )

    # menu ---------------------------------------------------------------------
    def categories(self) -> DataFrame:
        if self._categories is None:
            names = self.source("part").select(F.col("p_type").alias("name")).distinct()
            ids = assign_ids(names, "category_id", ["name"])
            self._categories = ids.select("category_id", "name")
        return self._categories

    def dishes(self) -> DataFrame:
        """Dishes without ``category_id``; ``category`` is still a name here."""
        return self.source("part").select(
            F.col("p_partkey").alias("dish_id"),
            F.col("p_type").alias("category"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("description"),
            (60 * F.col("p_size").cast("long")).alias("prep_s"),
            F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
        )

    def dishes_with_category(self) -> DataFrame:
        resolved, _ = resolve_names(
            self.dishes(), "category", self.categories(), "name", "category_id"
        )
        return resolved

    # orders -------------------------------------------------------------------
    def orders(self) -> DataFrame:
        return self.source("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            (F.col("o_orderkey") % 150).alias("waiter_id"),
            ((F.col("o_orderkey") * 13 + 5) % self.n_tables()).alias("table_id"),
        )

    def order_lines(self, *statuses: int) -> DataFrame:
        """All lines, or those with the given statuses. They are filtered by the stored code, so
        that the scan can skip row groups."""
        return self._as_lines(self._with_status(self.source("lineitem"), statuses))

    @staticmethod
    def _with_status(rows: DataFrame, statuses: tuple[int, ...]) -> DataFrame:
        codes = {C.REQUESTED: "A", C.PREPARED: "N", C.DELIVERED: "R"}
        wanted = [codes[s] for s in statuses]
        return rows.filter(F.col("l_returnflag").isin(*wanted)) if wanted else rows

    def numbered_lines(self) -> DataFrame:
        """All lines with a ``line_id``: the place in the order of all columns, as the rows have no
        key. Equal rows can stand for each other. Numbered once, when first asked for."""
        if self._lines is None:
            columns = [c.split(" ")[0] for c in SOURCES["lineitem"].split(", ")]
            self._lines = assign_ids(self.source("lineitem"), "line_id", columns)
        return self._lines

    def last_line_id(self) -> DataFrame:
        """One row with the highest ``line_id``: lines are numbered from 1, so their count tells it without a sort."""
        return self.source("lineitem").agg(F.count("*").alias("line_id"))

    def unnumbered_preparations(self) -> DataFrame:
        """Preparations without the id of their line, for what only asks for the cook."""
        return self.source("lineitem").select(
            F.col("l_suppkey").alias("cook_id"), F.lit(None).cast("long").alias("line_id"))

    def lines_with_id(self) -> DataFrame:
        return self._as_lines(self.numbered_lines(), "line_id")

    @staticmethod
    def _as_lines(rows: DataFrame, *more: str) -> DataFrame:
        flag = F.col("l_returnflag")
        return rows.select(
            *more,
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("dish_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_suppkey").alias("cook_id"),
            F.when(flag == "A", C.REQUESTED).when(flag == "N", C.PREPARED)
            .when(flag == "R", C.DELIVERED).alias("status"),
            F.col("l_quantity").cast("long").alias("qty"),
            F.col("l_shipdate").alias("requested"),
        )

    def specialties(self) -> DataFrame:
        return self.source("lineitem").select(
            F.col("l_suppkey").alias("cook_id"), F.col("l_partkey").alias("dish_id")
        ).distinct()

    def preparations(self) -> DataFrame:
        return self.numbered_lines().select(F.col("l_suppkey").alias("cook_id"), "line_id")

    def claimed_lines(self) -> DataFrame:
        """Preparations by line id, some claimed by a cook who does not know the dish."""
        cook = F.col("l_suppkey")
        other = cook - cook % 10 + 3
        return self.numbered_lines().select(
            "line_id", F.when(F.col("l_linenumber") % 2 == 0, other).otherwise(cook).alias("cook_id")
        )

    def claimed_preparations(self) -> DataFrame:
        """Preparations some of which are claimed by a cook who does not know the dish."""
        cook = F.col("l_suppkey")
        other = cook - cook % 10 + 3
        return self.source("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.when(F.col("l_linenumber") % 2 == 0, other).otherwise(cook).alias("cook_id"),
            F.col("l_partkey").alias("dish_id"),
        )

    def booking_changes(self) -> DataFrame:
        """Status changes of bookings, several per booking, from all order lines."""
        flag = F.col("l_returnflag")
        return self.source("lineitem").select(
            F.col("l_orderkey").alias("booking_id"),
            F.when(flag == "A", C.OCCUPIED).when(flag == "N", C.RELEASED)
            .otherwise(C.CANCELLED).alias("status"),
            F.col("l_shipdate").alias("changed"),
        )

    def order_forms(self) -> DataFrame:
        """One submitted form per order with three entries; some entries have no quantity."""
        key = F.col("o_orderkey")
        entry = lambda i: F.struct(
            ((key * 7 + 11 * i) % 200).alias("dish_id"), ((key + i) % 5 - 2).alias("qty")
        )
        return self.source("orders").select(
            key.alias("form_id"),
            F.col("o_custkey").alias("customer_id"),
            (key % 150).alias("waiter_id"),
            ((key * 13 + 5) % self.n_tables()).alias("table_id"),
            F.array(entry(0), entry(1), entry(2)).alias("entries"),
        )
