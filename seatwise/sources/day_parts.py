"""Daily figures kept up to date: stored sums per day and dish, merged with what each batch of changes adds and takes away."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.functions.columns import DELIVERED, line_amount
from seatwise.workspace import written

_PARTS = "dish_id long, n_lines long, qty long, n_delivered long, qty_delivered long"
_MONTH = "day_month"


def _folded(rows: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in _PARTS.split(", ")][1:]
    return rows.groupBy("day", "dish_id").agg(*[F.sum(c).cast("long").alias(c) for c in names])


def day_parts(lines: DataFrame, sign: int = 1) -> DataFrame:
    """Counts and quantities per day and dish, of all lines and of delivered ones, times ``sign``. Lines that were
    never requested belong to no day."""
    done = F.col("status") == DELIVERED
    rows = lines.filter(F.col("requested").isNotNull()).select(
        F.col("requested").cast("date").alias("day"), F.col("dish_id").cast("long").alias("dish_id"),
        F.lit(sign).cast("long").alias("n_lines"), (sign * F.col("qty")).cast("long").alias("qty"),
        F.when(done, sign).otherwise(0).cast("long").alias("n_delivered"),
        F.when(done, sign * F.col("qty")).otherwise(0).cast("long").alias("qty_delivered"),
    )
    return _folded(rows)


def changed_parts(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a batch of changes adds to the parts: lines as they were (``before``) count negative, as they are now
    positive. An inserted line is in ``after`` alone, a deleted one in ``before`` alone; a line that moves to
    another day takes from one and adds to the other. Parts that do not change are left out."""
    both = _folded(day_parts(before, -1).unionByName(day_parts(after, 1)))
    return both.filter("n_lines <> 0 OR qty <> 0 OR n_delivered <> 0 OR qty_delivered <> 0")


def write_day_parts(lines: DataFrame, home: str) -> None:
    """The parts of all lines, stored anew under ``home`` in a folder per month."""
    _write(day_parts(lines).withColumn(_MONTH, F.date_format("day", "yyyy-MM")), f"{home}/parts")


def _write(parts: DataFrame, path: str, mode: str = "static") -> None:
    placed = parts.repartition(_MONTH).sortWithinPartitions(_MONTH, "day")
    placed.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(_MONTH).parquet(path)


def read_day_parts(spark: SparkSession, home: str) -> DataFrame:
    """Parts per day and dish that still have lines."""
    stored = spark.read.schema(f"day date, {_PARTS}, {_MONTH} string").parquet(f"{home}/parts")
    return stored.filter("n_lines <> 0").drop(_MONTH)


def _listed(spark: SparkSession, path: str, batch: str) -> bool:
    try:
        return not spark.read.schema("batch string").parquet(path).filter(F.col("batch") == batch).isEmpty()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def _list(spark: SparkSession, path: str, batch: str) -> None:
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(path)


def merge_day_parts(spark: SparkSession, home: str, before: DataFrame, after: DataFrame, batch: str) -> bool:
    """Merges the changes of one named batch into the stored parts, once however often it is run: False if it was merged.

    Only the months that change are read and replaced. Their new rows are written beside the parts and entered in
    a list first, so a run that breaks off while months are replaced is completed from there when it is repeated, without
    counting anything twice. Batches come one after the other, each repeated until it succeeds. A dish whose
    lines are all gone stays with zeros, so that no month has to be deleted.
    """
    merged, staged, ready = (f"{home}/{name}" for name in ("merged", f"staged/batch={batch}", "ready"))
    if _listed(spark, merged, batch):
        return False
    if not _listed(spark, ready, batch):
        month = F.date_format("day", "yyyy-MM").alias(_MONTH)
        delta = written(changed_parts(before, after).select("*", month), "day-deltas")
        months = [r[_MONTH] for r in delta.select(_MONTH).distinct().collect()]  # a row per month of the calendar at most
        schema = f"day date, {_PARTS}, {_MONTH} string"
        stored = spark.read.schema(schema).parquet(f"{home}/parts").filter(F.col(_MONTH).isin(months))
        _folded(stored.unionByName(delta)).select("*", month).write.mode("overwrite").parquet(staged)
        _list(spark, ready, batch)
    _write(spark.read.schema(f"day date, {_PARTS}, {_MONTH} string").parquet(staged), f"{home}/parts", "dynamic")
    _list(spark, merged, batch)
    return True


def daily_figures(parts: DataFrame, dishes: DataFrame) -> DataFrame:
    """Per day: lines, units, the dish on most lines (ties by name), the value of all lines and of delivered ones.

    The counts of all dishes are kept, so the star dish can fall as well as rise; dishes without
    a name or price count in the lines only.
    """
    rows = parts.join(dishes.select(F.col("dish_id").cast("long").alias("dish_id"), "name", "price"), "dish_id", "left")
    rank = F.when(F.col("name").isNotNull(), F.struct(-F.col("n_lines"), "name", "dish_id"))
    return rows.groupBy("day").agg(
        F.sum("n_lines").alias("n_lines"), F.sum("qty").alias("units"),
        F.min_by("name", rank).alias("star_dish"),
        F.sum(line_amount("qty", "price")).cast("decimal(38,2)").alias("gross_revenue"),
        F.sum(line_amount("qty_delivered", "price")).cast("decimal(38,2)").alias("total_sales"),
    )
