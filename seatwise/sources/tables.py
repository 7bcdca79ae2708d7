"""Parquet sources and sinks: typed model scan, append with defaults, slots by month."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.functions.columns import MAX_DURATION_S, REQUESTED, RESERVED
from seatwise.sources.schemas import TABLES
from seatwise.workspace import written

# What an insert that leaves a column out stores there.
DEFAULTS = {
    "users": {"digest_ts": F.localtimestamp},
    "bookings": {"status": lambda: F.lit(RESERVED)},
    "slots": {"duration_s": lambda: F.lit(MAX_DURATION_S)},
    "order_lines": {"status": lambda: F.lit(REQUESTED), "requested": F.current_timestamp},
}

MONTH = "slot_month"


def load_model(
    spark: SparkSession, folder: str, tables: Iterable[str] = TABLES
) -> dict[str, DataFrame]:
    """Typed lazy scans of the model tables (all 12 by default) under ``folder``/<table>."""
    return {
        name: spark.read.schema(TABLES[name]).parquet(f"{folder.rstrip('/')}/{name}")
        for name in tables
    }


def with_defaults(new: DataFrame, table: str) -> DataFrame:
    """Rows shaped and typed like ``table``; absent or NULL columns take their default."""
    defaults, columns = DEFAULTS.get(table, {}), []
    for field in TABLES[table].split(", "):
        name, kind = field.split(" ", 1)
        value = F.col(name) if name in new.columns else F.lit(None)
        if name in defaults:
            value = F.coalesce(value, defaults[name]())
        columns.append(value.cast(kind).alias(name))
    return new.select(columns)


def _of_allowed_length(slots: DataFrame) -> DataFrame:
    """Fails the write on a slot longer than the longest allowed one: readers look back no further."""
    text = F.format_string("slot %s lasts %s s, more than allowed", F.col("slot_id"), F.col("duration_s"))
    checked = F.when(F.col("duration_s") > MAX_DURATION_S, F.raise_error(text)).otherwise(F.col("duration_s"))
    return slots.withColumn("duration_s", checked.cast("long"))


def append_rows(new: DataFrame, table: str, folder: str) -> None:
    """Multi-row insert into a parquet table."""
    rows = with_defaults(new, table)
    (_of_allowed_length(rows) if table == "slots" else rows).write.mode("append").parquet(f"{folder.rstrip('/')}/{table}")


CELL_BITS = 6


def _interleaved(first: Column, second: Column) -> Column:
    """The bits of two numbers below 2^``CELL_BITS`` in turn, the first one's ahead: neighbours in both stay together."""
    bit = lambda n, i, at: F.shiftleft(F.shiftright(n, i).bitwiseAND(F.lit(1)), at)
    parts = [bit(n, i, 2 * i + ahead) for i in range(CELL_BITS) for n, ahead in ((first, 1), (second, 0))]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def _placed(slots: DataFrame) -> Column:
    """Cell of a slot among 64 shares of the tables by their number of slots and 64 half-days of the month."""
    cells = 1 << CELL_BITS
    shares = F.percentile_approx("table_id", F.array(*[F.lit(i / cells) for i in range(1, cells)]), 10_000)
    # 63 numbers, whatever the table's size. Tables that fill several shares lie in the last of them.
    bounds = slots.agg(shares.alias("b")).first()["b"] or []
    bounds = F.array(*[F.lit(v) for v in sorted(set(bounds))]).cast("array<bigint>")
    table = F.size(F.filter(bounds, lambda v: v <= F.col("table_id")))
    half_day = 2 * (F.dayofmonth("start") - 1) + F.floor(F.hour("start") / 12).cast("int")
    return F.coalesce(_interleaved(F.coalesce(table, F.lit(0)), half_day), F.lit(-1))


def _laid_out(rows: DataFrame, by_table: bool, tasks: int | None) -> DataFrame:
    """Rows with their month, spread over tasks by ranges and sorted within them."""
    order = [F.col("start"), F.col("slot_id")]
    if by_table:
        order = [F.col(MONTH), _placed(rows), *order]
    spread = rows.repartitionByRange(tasks, *order) if tasks else rows.repartitionByRange(*order)
    return spread.sortWithinPartitions(MONTH, "table_id", "start") if by_table else spread.sortWithinPartitions("start")


def write_slots_by_month(
    slots: DataFrame, path: str, mode: str = "overwrite", by_table: bool = False, tasks: int | None = None
) -> None:
    """Slots in one folder per month of ``start``; a NULL start lands in the default folder.

    Ranges of (start, id) are spread over the tasks: each task writes one or two months,
    a month that holds most of the table is still written by many tasks, and the files of
    a month cover narrow time ranges, which lets the scan skip them by their statistics.

    With ``by_table`` the files of a month cover narrow ranges of tables and of time: rows are in the order of the
    interleaved bits of both, so that a filter on either skips most files, and one on both nearly all. Shares of tables hold
    about equal numbers of slots; a table with most of them is split by time. ``tasks`` sets the number of files.
    """
    rows = _of_allowed_length(slots).withColumn(MONTH, F.date_format("start", "yyyy-MM"))
    _laid_out(rows, by_table, tasks).write.mode(mode).partitionBy(MONTH).parquet(path)


def read_slots_between(
    spark: SparkSession, path: str, since: str, until: str, columns: list[str] | None = None,
    tables: tuple[int, int] | None = None,
) -> DataFrame:
    """Slots that overlap [since, until), reading only the months that can hold them; of the tables from one
    number to another, if these are given.

    A slot may start up to the longest allowed duration before ``since``, so the first
    month is taken from there. Spark does not derive the month filter from ``start``.
    """
    since_ts, until_ts = (F.lit(t).cast("timestamp_ntz") for t in (since, until))
    earliest = since_ts - F.make_dt_interval(*[F.lit(0)] * 3, F.lit(MAX_DURATION_S))
    schema = TABLES["slots"] + f", {MONTH} string"
    found = spark.read.schema(schema).parquet(path).filter(
        F.col(MONTH).between(_month(earliest), _month(until_ts))
        & (F.col("start") >= earliest)
        & (F.col("start") < until_ts)
        & (F.col("start") + F.make_dt_interval(*[F.lit(0)] * 3, F.col("duration_s")) > since_ts)
    )
    if tables:
        found = found.filter(F.col("table_id").between(*tables))
    return found.select(columns) if columns else found.drop(MONTH)


def _month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


# changes of stored slots -------------------------------------------------------------------


def _months_of(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.select("slot_id", MONTH).join(ids, "slot_id", "left_semi").select(MONTH)


def change_slots(
    spark: SparkSession, path: str, updates: DataFrame | None = None, deletes: DataFrame | None = None, dry_run: bool = False,
    by_table: bool = False, tasks: int | None = None,
) -> DataFrame:
    """Update or delete slots stored by ``write_slots_by_month``, rewriting only the months that this touches.

    ``updates`` has slot_id (unique) and any columns to set; a new ``start`` moves a slot to its month. ``deletes`` has
    slot_id and wins over an update. Ids that are not stored change nothing. Returns a row per touched month, with
    rows before and after; with ``dry_run`` that is all, and no file is changed.

    The touched months are found by ids alone (two columns are read), and new rows are written to the shared folder before
    any month is replaced, so that a run that breaks off can be repeated: setting the same values
    again gives the same rows. Months are replaced by one dynamic partition overwrite; a month that
    loses its last row by an empty file. ``by_table`` and ``tasks`` lay the new files out as ``write_slots_by_month`` does.
    """
    schema = TABLES["slots"] + f", {MONTH} string"
    stored = spark.read.schema(schema).parquet(path)
    none = stored.select("slot_id").limit(0)
    gone = none if deletes is None else deletes.select("slot_id").distinct()
    changed = none if updates is None else updates.join(gone, "slot_id", "left_anti")
    ids = gone.unionByName(changed.select("slot_id")).distinct()
    # A slot that moves to a month brings that month in: its rows are kept beside the new one.
    touched = _months_of(stored, ids)
    month = F.date_format("start", "yyyy-MM")
    if "start" in changed.columns:
        touched = touched.unionByName(changed.join(stored.select("slot_id"), "slot_id", "left_semi").select(month.alias(MONTH)))
    months = [r[MONTH] for r in touched.distinct().collect()]  # a row per month of the calendar at most
    in_months = F.col(MONTH).isin([m for m in months if m is not None])
    if None in months:
        in_months = in_months | F.col(MONTH).isNull()
    before = stored.filter(in_months)
    names = [c for c in changed.columns if c != "slot_id"]
    new = {c: F.col(f"_new.{c}") for c in names}
    held = changed.select("slot_id", F.struct(F.lit(True).alias("_set"), *names).alias("_new"))
    rows = before.join(gone, "slot_id", "left_anti").join(held, "slot_id", "left").select(*[
        F.when(F.col("_new").isNotNull(), new[c]).otherwise(F.col(c)).cast(stored.schema[c].dataType).alias(c)
        if c in new else F.col(c) for c in stored.columns if c != MONTH
    ])
    staged = written(_of_allowed_length(rows).withColumn(MONTH, month), "changed-slots")
    report = written(before.groupBy(MONTH).agg(F.count("*").alias("n_before")).join(
        staged.groupBy(F.col(MONTH).alias("_m")).agg(F.count("*").alias("n_after")), F.col(MONTH).eqNullSafe(F.col("_m")), "full"
    ).select(F.coalesce(MONTH, "_m").alias(MONTH), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_before", "n_after")]), "report")
    if not dry_run and months:
        (
            _laid_out(staged, by_table, tasks).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
        )
        for r in report.filter("n_after = 0").collect():
            name = "__HIVE_DEFAULT_PARTITION__" if r[MONTH] is None else r[MONTH]
            staged.drop(MONTH).limit(0).write.mode("overwrite").parquet(f"{path}/{MONTH}={name}")
    return report


def append_once(new: DataFrame, table: str, folder: str, batch: str) -> bool:
    """Multi-row insert under the name ``batch``, stored once however often it is run: False if it was there.

    The rows go to a folder of their own, which a repeated run replaces, and count from the moment the
    batch is entered in the list of those that are complete. ``read_appended`` reads the complete ones.
    """
    spark, home = new.sparkSession, f"{folder.rstrip('/')}/{table}"
    done = _complete(spark, home)
    if done is not None and not done.filter(F.col("batch") == batch).isEmpty():
        return False
    rows = with_defaults(new, table)
    (_of_allowed_length(rows) if table == "slots" else rows).write.mode("overwrite").parquet(f"{home}/rows/batch={batch}")
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{home}/complete")
    return True


def _complete(spark: SparkSession, home: str) -> DataFrame | None:
    try:
        return spark.read.schema("batch string").parquet(f"{home}/complete").distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_appended(spark: SparkSession, table: str, folder: str) -> DataFrame:
    """Rows of the complete batches of ``append_once``; those of a run that broke off are left out."""
    home = f"{folder.rstrip('/')}/{table}"
    done = _complete(spark, home)
    if done is None:
        return spark.createDataFrame([], TABLES[table])
    rows = spark.read.schema(TABLES[table] + ", batch string").parquet(f"{home}/rows")
    return rows.join(done, "batch", "left_semi").drop("batch")
