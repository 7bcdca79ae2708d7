"""Streams over booking events and order lines.

Each ``stream_*`` function starts a query and returns it; results land in parquet under
``out``. Sinks are the file sink or ``foreachBatch`` writing one folder per batch id, so a
batch that is run again after a failure replaces its own output.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from seatwise.functions.columns import (
    DELIVERED, MAX_DURATION_S, PREPARED, TABLE_STATE, line_amount, ready_text, slot_end, wall_clock_as_utc,
)
from seatwise.plans.floor import board_rows, instant, table_board, upcoming_bookings
from seatwise.sources.tables import MONTH


def file_stream(
    spark: SparkSession, folder: str, pattern: str, schema: StructType | str, **options: str
) -> DataFrame:
    """Stream of the parquet files in ``folder`` whose names match ``pattern``."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return reader.options(**options).parquet(folder)


def _start(writer, out: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", f"{out}/_progress")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def read_rows(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/rows")


def stream_ready_alerts(
    lines: DataFrame, orders: DataFrame, users: DataFrame, dishes: DataFrame, out: str,
    once: bool = True,
) -> StreamingQuery:
    """One alert per line that arrives as prepared, with table, waiter, dish and text."""
    waiters = users.select(F.col("user_id").alias("waiter_id"), F.col("name").alias("waiter"))

    def alerts(batch: DataFrame) -> DataFrame:
        # Orders are cut to the batch before anything else: by range, which the scan can use, then by id.
        span = batch.agg(F.min("order_id").alias("low"), F.max("order_id").alias("high")).first()
        near = orders.filter(F.col("order_id").between(span["low"], span["high"]))
        heads = near.join(batch.select("order_id").distinct(), "order_id", "left_semi").join(waiters, "waiter_id")
        return (
            batch.join(dishes.select("dish_id", F.col("name").alias("dish")), "dish_id")
            .join(heads.select("order_id", "table_id", "waiter"), "order_id")
            .select(
                "order_id", "table_id", "waiter", "dish", "qty", "requested",
                ready_text("order_id", "waiter").alias("message"),
            )
        )

    ready = lines.filter((F.col("status") == PREPARED) & F.col("order_id").isNotNull())
    return _per_batch(ready, alerts, out, once)


def _per_batch(events: DataFrame, write, out: str, once: bool) -> StreamingQuery:
    """Each batch is held while its rows are made, and a batch without rows writes nothing."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                write(batch).write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
        finally:
            batch.unpersist()

    return _start(events.writeStream.foreachBatch(run), out, once)


def stream_upcoming_alerts(
    ticks: DataFrame, slots: DataFrame, bookings: DataFrame, users: DataFrame, out: str,
    horizon_s: int = 1800, once: bool = True,
) -> StreamingQuery:
    """Reserved bookings about to start, for every distinct reference time ``at`` that a
    batch brings. A time that comes again in a later batch gives the same rows; readers
    use ``upcoming_alerts``, which keeps one of each.

    A batch spans little time, so slots are first cut to that span: the scan skips the
    months and files outside it.
    """
    def soon(batch: DataFrame) -> DataFrame:
        span = batch.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
        low, high = instant(span["low"]), slot_end(instant(span["high"]), F.lit(horizon_s))
        near = slots.filter(F.col("start").between(low, high))
        if MONTH in slots.columns:
            near = near.filter(F.col(MONTH).between(
                F.date_format(low, "yyyy-MM"), F.date_format(high, "yyyy-MM")))
        refs = batch.select("at").distinct()
        return upcoming_bookings(refs, near, bookings, users, horizon_s)

    return _per_batch(ticks.filter(F.col("at").isNotNull()), soon, out, once)


def upcoming_alerts(spark: SparkSession, out: str) -> DataFrame:
    return read_rows(spark, out).drop("batch").distinct()


def stream_once(
    alerts: DataFrame, keys: list[str], at: str, within: str, out: str, once: bool = True
) -> StreamingQuery:
    """Of the alerts with equal ``keys`` only the first one to arrive, however often and in however many batches
    they come again, so that readers need no ``distinct``.

    The keys seen are streaming state, kept until the latest ``at`` is more than ``within`` past a key's
    first one: state holds the keys of that span of time. Alerts further behind the latest one are dropped as too late.
    """
    seen = alerts.withColumn("_at", wall_clock_as_utc(at)).withWatermark("_at", within)
    return _start(
        seen.dropDuplicatesWithinWatermark(keys).drop("_at").writeStream.format("parquet").option("path", f"{out}/rows"),
        out, once,
    )


def stream_upcoming_once(spark: SparkSession, found: str, out: str, horizon_s: int = 1800, once: bool = True) -> StreamingQuery:
    """Each booking and start alerted once, from what ``stream_upcoming_alerts`` writes under ``found``. A booking
    is announced at most ``horizon_s`` before its start, so keys of that span are all that has to be kept."""
    schema = "at timestamp_ntz, booking_id long, customer string, table_id long, start timestamp_ntz, `end` timestamp_ntz, batch int"
    alerts = file_stream(spark, f"{found}/rows", "*.parquet", schema).drop("batch")
    return stream_once(alerts, ["booking_id", "start"], "at", f"{horizon_s} seconds", out, once)


def stream_table_board(
    ticks: DataFrame, tables: DataFrame, slots: DataFrame, bookings: DataFrame,
    users: DataFrame, orders: DataFrame, out: str, once: bool = True,
    longest_s: int | None = None,
) -> StreamingQuery:
    """The floor board as of the latest reference time of each batch. Give ``longest_s`` where
    no stored slot is longer (as the writers of this library ensure): it keeps the scan to recent files."""
    def latest(batch: DataFrame) -> DataFrame:
        # One row per refresh: the board shows one instant.
        now = batch.agg(F.max("at").alias("at")).first()["at"]
        board = table_board(
            tables, slots, bookings, users, orders, now, longest_s=longest_s
        )
        return board.withColumn("at", instant(now))

    return _per_batch(ticks.filter(F.col("at").isNotNull()), latest, out, once)


def stream_floor_changes(
    slots: DataFrame, orders: DataFrame, out: str, lateness: str = "30 minutes", once: bool = True
) -> StreamingQuery:
    """What a floor board needs, from a stream of slots (slot_id, table_id, customer_id, start, duration_s; no customer
    where there is no booking) and a stream of orders (customer_id, placed): each slot when it arrives, and
    again with the day when its customer is known to have ordered on a day that it touches. A batch writes what it
    changes and nothing else; ``floor_board`` reads the slots of the last two hours.

    The streams are joined on the customer, within the time that can matter to a board as of the latest event: a slot waits for
    orders for the longest slot (two hours), an order for slots of its day. Both go from the state once the later of
    the two streams' watermarks allows it, so a slot waits as long as it may still be on, and an order no
    longer than a day. Orders of a customer that come within ``lateness`` of each other on a day are one row of
    state. Rows more than ``lateness`` behind both streams are left out.
    """
    timed = slots.withColumn("_start", wall_clock_as_utc("start")).withWatermark("_start", lateness)
    arrived = timed.select(
        "slot_id", "table_id", "customer_id", "start", slot_end("start", "duration_s").alias("end"), "_start")
    placed = (
        orders.filter(F.col("customer_id").isNotNull() & F.col("placed").isNotNull())
        .select(F.col("customer_id").alias("_customer"), F.col("placed").cast("date").alias("ordered_day"),
                wall_clock_as_utc("placed").alias("_placed"))
        .withWatermark("_placed", lateness).dropDuplicatesWithinWatermark(["_customer", "ordered_day"])
    )
    met = arrived.join(placed, (F.col("customer_id") == F.col("_customer")) & F.expr(
        f"_placed > _start - INTERVAL 24 HOURS AND _placed <= _start + INTERVAL {MAX_DURATION_S} SECONDS"
    ) & F.col("ordered_day").between(F.col("start").cast("date"), F.col("end").cast("date")))
    names = ["slot_id", "table_id", "customer_id", "start", "end", "ordered_day"]
    changes = met.select(names).unionByName(arrived.withColumn("ordered_day", F.lit(None).cast("date")).select(names))

    def run(batch: DataFrame, batch_id: int) -> None:
        # By day first, so that a reader opens the files of one or two days; a repeated batch replaces its own folders.
        rows = batch.withColumn("day", F.col("start").cast("date")).withColumn("batch", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{out}/rows")

    return _start(changes.writeStream.outputMode("append").foreachBatch(run), out, once)


def floor_board(
    spark: SparkSession, out: str, tables: DataFrame, users: DataFrame, at: datetime | str,
    labels: tuple[str, str, str] = TABLE_STATE,
) -> DataFrame:
    """The floor board as of ``at``, the time of the latest event or a later one, from what ``stream_floor_changes`` wrote:
    the same rows as ``table_board`` gives for all slots and orders that have arrived. It reads the days that a slot which is
    still on can have started on, so its cost does not grow with what is stored."""
    now = instant(at)
    since = slot_end(now, F.lit(-MAX_DURATION_S))
    schema = ("slot_id long, table_id long, customer_id long, start timestamp_ntz, `end` timestamp_ntz, "
              "ordered_day date, day date, batch long")
    on = spark.read.schema(schema).parquet(f"{out}/rows").filter(
        F.col("day").between(since.cast("date"), now.cast("date"))
        & F.col("start").between(since, now) & (F.col("end") >= now))
    seated = on.groupBy("slot_id", "table_id", "customer_id").agg(
        F.max(F.coalesce(F.col("ordered_day") == now.cast("date"), F.lit(False))).alias("_ordered"))
    names = users.select(F.col("user_id").alias("customer_id"), F.col("name").alias("customer"))
    rows = seated.join(names, "customer_id", "left").select(
        "table_id", "customer", F.col("customer_id").isNotNull().alias("_booked"), "_ordered")
    return board_rows(tables, rows, labels)


def stream_live_board(
    events: DataFrame, key: str, state: list[str], order: list[str], out: str, once: bool = True
) -> StreamingQuery:
    """Latest ``state`` per ``key``, as changed keys per batch. Rows of a batch are reduced
    to one per key with map-side combine; the kept state is one row per key."""
    latest = events.groupBy(key).agg(
        F.max(F.struct(*order, *[c for c in state if c not in order])).alias("_last")
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.select(key, "_last.*").write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    return _start(latest.writeStream.outputMode("update").foreachBatch(run), out, once)


def _if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def live_board(spark: SparkSession, out: str, key: str, keep_batch: bool = False) -> DataFrame:
    """Current board: per key the row of its last batch, from the batches and what was folded of earlier ones."""
    found = [df for df in (_if_there(spark, f"{out}/{part}") for part in ("rows", "folded")) if df is not None]
    rows = reduce(DataFrame.unionByName, found) if found else read_rows(spark, out)
    value = F.struct(*[c for c in rows.columns if c != key])
    board = rows.groupBy(key).agg(F.max_by(value, "batch").alias("_v")).select(key, "_v.*")
    return board if keep_batch else board.drop("batch")


def compact_board(spark: SparkSession, out: str, key: str) -> None:
    """Folds all batches of a board that is not running into one row per key.

    The folded board is written beside the batches before these are replaced by it, and readers take both:
    whenever it breaks off, at least one of the two is whole, and a repeated call completes it.
    """
    live_board(spark, out, key, keep_batch=True).write.mode("overwrite").partitionBy("batch").parquet(f"{out}/next")
    for part in ("folded", "rows"):
        spark.read.parquet(f"{out}/next").write.mode("overwrite").partitionBy("batch").parquet(f"{out}/{part}")


def stream_daily_sales(
    lines: DataFrame, dishes: DataFrame, out: str, once: bool = True
) -> StreamingQuery:
    """Delivered sales and line counts per calendar day, open days included.

    Lines come in any order of their request times, so no row is too late: the totals of all days
    are the state (a row per day), and each batch writes them anew, in the place of the last but one: the
    one before it stays whole for readers until the new one is.
    """
    sold = lines.filter(F.col("status") == DELIVERED).join(
        dishes.select("dish_id", "price"), "dish_id"
    )
    days = sold.groupBy(F.col("requested").cast("date").alias("day")).agg(
        F.sum(line_amount("qty", "price")).alias("total_sales"), F.count("*").alias("n_lines")
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        state = batch.withColumn("batch", F.lit(batch_id).cast("long"))
        state.write.mode("overwrite").parquet(f"{out}/rows/turn={batch_id % 2}")

    return _start(days.writeStream.outputMode("complete").foreachBatch(run), out, once)


def daily_sales(spark: SparkSession, out: str) -> DataFrame:
    """Totals as of the last batch."""
    rows = read_rows(spark, out)
    last = rows.agg(F.max("batch").alias("b")).first()["b"]
    return rows.filter(F.col("batch") == F.lit(last)).drop("batch", "turn")


# days that are closed, and what comes late ------------------------------------------------


def _day(at: Column) -> Column:
    """Calendar day of an instant that stands for a wall clock in UTC, whatever the session's zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(at) / F.lit(86_400_000_000)).cast("int"))


def _valued(sums: DataFrame, dishes: DataFrame) -> DataFrame:
    """Totals per day from quantities per day and dish: prices are joined to sums, never to lines."""
    priced = sums.join(dishes.select("dish_id", "price"), "dish_id")
    return priced.groupBy("day").agg(
        F.sum(line_amount("qty", "price")).alias("total_sales"), F.sum("n_lines").alias("n_lines")
    )


def stream_closed_days(
    lines: DataFrame, dishes: DataFrame, out: str, lateness: str = "1 day", once: bool = True
) -> StreamingQuery:
    """Delivered sales of each calendar day, written once, when the day is over: as soon as a line was requested more than
    ``lateness`` after its end. State holds open days only (a row per day and dish); no day is written again. Lines
    that come later than that are not in it: ``day_corrections`` has them.
    """
    sold = lines.filter(F.col("status") == DELIVERED).withColumn("_at", wall_clock_as_utc("requested"))
    days = sold.withWatermark("_at", lateness).groupBy(F.window("_at", "1 day").alias("_w"), "dish_id").agg(
        F.sum("qty").alias("qty"), F.count("*").alias("n_lines")
    ).select(_day(F.col("_w.start")).alias("day"), "dish_id", "qty", "n_lines")

    def run(batch: DataFrame, batch_id: int) -> None:
        # All dishes of a day are closed in one batch, so a day is one row.
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                _valued(batch, dishes).write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
        finally:
            batch.unpersist()

    return _start(days.writeStream.outputMode("append").foreachBatch(run), out, once)


def stream_day_parts(lines: DataFrame, dishes: DataFrame, out: str, once: bool = True) -> StreamingQuery:
    """What each batch adds to the delivered sales of each day: a row per day that it touches, late ones included, and no
    state. ``sales_so_far`` adds them up."""
    sold = lines.filter(F.col("status") == DELIVERED)

    def parts(batch: DataFrame) -> DataFrame:
        sums = batch.groupBy(F.col("requested").cast("date").alias("day"), "dish_id").agg(
            F.sum("qty").alias("qty"), F.count("*").alias("n_lines"))
        return _valued(sums, dishes)

    return _per_batch(sold, parts, out, once)


def sales_so_far(spark: SparkSession, out: str) -> DataFrame:
    """Totals of all days from the parts of all batches."""
    return read_rows(spark, out).groupBy("day").agg(
        F.sum("total_sales").cast("decimal(38,2)").alias("total_sales"), F.sum("n_lines").alias("n_lines"))


def closed_days(spark: SparkSession, out: str) -> DataFrame:
    return read_rows(spark, out).select("day", F.col("total_sales").cast("decimal(38,2)").alias("total_sales"), "n_lines")


def day_corrections(spark: SparkSession, closed: str, parts: str) -> DataFrame:
    """What lines that came after their day was closed add to it: with the closed days it makes up the totals of all
    lines so far. Days that are still open, or were closed rightly, have no row. Days whose
    lines all came too late have no closed row and are corrected from nothing."""
    latest = read_rows(spark, closed).agg(F.max("day")).scalar()
    done = closed_days(spark, closed).withColumnsRenamed({"total_sales": "_sales", "n_lines": "_n"})
    return sales_so_far(spark, parts).filter(F.col("day") <= latest).join(done, "day", "left").select(
        "day", (F.col("total_sales") - F.coalesce("_sales", F.lit(0))).cast("decimal(38,2)").alias("total_sales"),
        (F.col("n_lines") - F.coalesce("_n", F.lit(0))).alias("n_lines"),
    ).filter(F.col("n_lines") != 0)
