"""Interval operators over bookings: overlap pairs, overlap sums, instants, look-ahead.

All intervals are half-open [start, end) for overlap, and closed at both ends for the
"active now" and "starting soon" questions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.functions.columns import MAX_DURATION_S, col, epoch_us, slot_end
from seatwise.operators.running import running

BUCKET_US = MAX_DURATION_S * 1_000_000
# Width of a dyadic cell of level 0, 2^33 microseconds or 2.4 hours; 12 levels of four to one reach 4,500 years.
_CELL_BITS = 33
# Parts that a time bucket is dealt into where nothing but time joins two tables.
PARTS = 16


def with_bounds(df: DataFrame, start: str = "start", duration: str = "duration_s") -> DataFrame:
    """Add ``_s`` and ``_e``, the interval bounds in microseconds."""
    return df.withColumn("_s", epoch_us(start)).withColumn(
        "_e", F.col("_s") + F.col(duration) * 1_000_000
    )


def bucket(at: Column, width: int) -> Column:
    return F.floor(at / F.lit(width)).cast("long")


def in_buckets(df: DataFrame, low: Column, high: Column, width: int, first: str) -> DataFrame:
    """One copy per time bucket that [low, high] touches, and the first bucket in ``first``."""
    return df.withColumn(first, bucket(low, width)).withColumn(
        "_bucket", F.explode(F.sequence(F.col(first), bucket(high, width)))
    )


def _dealt(many: DataFrame, few: DataFrame) -> DataFrame:
    """Equi-join on ``_bucket``, whose rows of ``many`` are dealt into PARTS by a hash of
    all their columns, while those of ``few`` (distinct instants) go to each part."""
    many = many.withColumn("_part", F.pmod(F.xxhash64(*many.columns), F.lit(PARTS)).cast("int"))
    few = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return many.join(few, ["_bucket", "_part"]).drop("_part")


def _top_level(low: Column, high: Column) -> Column:
    """The highest level on which [low, high] can have a cell."""
    n = F.shiftright(high, _CELL_BITS) - F.shiftright(low, _CELL_BITS) + 1
    return F.floor(F.log2(n) / 2 + 0.01).cast("int")


def dyadic_cells(low: Column, high: Column) -> Column:
    """The fewest cells, as an array of (_level, _cell), that cover [low, high] and do not overlap.

    A cell of level 0 is 2^33 microseconds wide, four cells of a level make one of the next. A range has at most six
    cells per level, so ten years take some tens of cells, and a slot of two hours one or two.
    """
    def bounds(level: Column) -> tuple[Column, Column]:
        up = F.call_function("shiftleft", F.lit(1).cast("long"), 2 * level) - 1
        first = F.call_function("shiftright", F.shiftright(low, _CELL_BITS) + up, 2 * level)
        return first, F.call_function("shiftright", F.shiftright(high, _CELL_BITS) + 1, 2 * level)

    def run(first: Column, end: Column) -> Column:
        return F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))

    def of_level(level: Column) -> Column:
        (first, end), (wide, wide_end) = bounds(level), bounds(level + 1)
        inner = wide < wide_end
        here = F.concat(run(first, F.when(inner, 4 * wide).otherwise(end)), run(F.when(inner, 4 * wide_end).otherwise(end), end))
        return F.transform(here, lambda c: F.struct(level.alias("_level"), c.alias("_cell")))

    return F.flatten(F.transform(F.sequence(F.lit(0), _top_level(low, high)), of_level))


def _starts_in(ranges: DataFrame, low: str, end: str, points: DataFrame, at: str, keys: list[str]) -> DataFrame:
    """Rows of ``points`` with those of ``ranges`` that have a cell around ``at``. Ranges of more than three cells of
    level 0 are first cut to the time in which their key has points, and only points of their keys are looked up on the wider levels, on
    those that such ranges of the key reach. All others have level 0 alone."""
    top = _top_level(F.col(low), F.col(end) - 1)
    short = ranges.filter(top == 0).withColumns({"_low": F.col(low), "_high": F.col(end) - 1})
    long = ranges.filter(top > 0)
    here = points.filter(F.col(at).isNotNull())
    within = here.join(long.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(
        F.min(at).alias("_from"), F.max(at).alias("_to"))
    # Beyond its key's points a range meets nothing.
    long = long.join(within, keys).withColumns({
        "_low": F.greatest(low, "_from"), "_high": F.least(F.col(end) - 1, F.col("_to"))}).drop("_from", "_to")
    cut = short.unionByName(long.filter(F.col("_low") <= F.col("_high")))
    cells = cut.select("*", F.inline(dyadic_cells(F.col("_low"), F.col("_high")))).drop("_low", "_high")
    reached = long.filter(F.col("_low") <= F.col("_high")).withColumn("_top", _top_level(F.col("_low"), F.col("_high")))
    reached = reached.filter("_top > 0").groupBy(*keys).agg(F.max("_top").alias("_top"))
    wide = here.join(reached, keys).withColumn("_level", F.explode(F.sequence(F.lit(1), F.col("_top")))).drop("_top")
    marks = here.withColumn("_level", F.lit(0)).unionByName(wide)
    marks = marks.withColumn("_cell", F.call_function("shiftright", F.col(at), _CELL_BITS + 2 * F.col("_level")))
    return cells.join(marks, [*keys, "_level", "_cell"]).filter(F.col(at) < F.col(end))


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], condition: Column | None = None
) -> DataFrame:
    """Pairs of rows with equal keys whose [_s, _e) ranges overlap, of any length.

    Right columns that also exist on the left (other than the keys) get a ``_2`` suffix.
    Two ranges overlap if the later one starts within the other, so each pair is found once: a start meets the
    dyadic cells of a range on its own and the wider levels. Cell and level are part of the hash key, so a busy key is
    spread over its cells, and the rows compared are within a constant factor of the rows returned.
    Rows with an empty or NULL range are left out.
    """
    keys = list(keys)
    valid = F.col("_s") < F.col("_e")
    a, b = left.filter(valid), right.filter(valid)
    b = b.withColumnsRenamed({c: f"{c}_2" for c in b.columns if c in a.columns and c not in keys})
    columns = [*a.columns, *[c for c in b.columns if c not in keys]]
    here = _starts_in(a, "_s", "_e", b, "_s_2", keys).filter(F.col("_s_2") >= F.col("_s"))
    there = _starts_in(b, "_s_2", "_e_2", a, "_s", keys).filter(F.col("_s") > F.col("_s_2"))
    pairs = here.select(*columns).unionByName(there.select(*columns))
    return pairs if condition is None else pairs.filter(condition)


def _edges(intervals: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """Two rows per interval: ``amount`` starting at ``_s`` and ending at ``_e``."""
    zero = F.lit(0).cast("long")
    amount = amount.cast("long")
    edges = F.array(
        F.struct(F.col("_s").alias("_at"), amount.alias("_started"), zero.alias("_ended")),
        F.struct(F.col("_e").alias("_at"), zero.alias("_started"), amount.alias("_ended")),
    )
    return intervals.select(*keys, F.inline(edges))


def overlap_sum(
    windows: DataFrame,
    intervals: DataFrame,
    amount: Column | str,
    name: str,
    keys: Sequence[str] = (),
    bounds_from: DataFrame | None = None,
) -> DataFrame:
    """Add to each window the sum of ``amount`` over all intervals that overlap it.

    Both sides need ``_s`` and ``_e``. Not a range join: an interval overlaps [s, e)
    unless it starts at or after e or ends at or before s, and the latter two exclude
    each other, so the answer is (amount started before e) - (amount ended by s). The
    work is a few sorts of n + m rows, whatever the number of overlapping pairs. Equal
    windows are answered once and joined back. Empty windows and NULL keys get 0.

    ``bounds_from`` may hold the same windows (keys, ``_s``, ``_e``) before other columns
    were joined to them, so that those joins are not computed again for the bounds.
    """
    keys = list(keys)
    valid = F.col("_s") < F.col("_e")
    facts = intervals.filter(valid).select(*keys, "_s", "_e", col(amount).alias("_amount"))
    source = windows if bounds_from is None else bounds_from
    spans = source.filter(valid).select(*keys, "_s", "_e")
    for k in keys:
        spans = spans.filter(F.col(k).isNotNull())
    spans = spans.distinct()
    points = _edges(facts, keys, F.col("_amount")).unionByName(_edges(spans, keys, F.lit(0)))
    sums = running(points, "_at", {"_started": "sum", "_ended": "sum"}, keys).select(
        *keys, "_at", "_started_before", (F.col("_ended") + F.col("_ended_before")).alias("_gone")
    )
    bounds = spans.select(
        *keys, "_s", "_e",
        F.inline(F.array(
            F.struct(F.col("_s").alias("_at"), F.lit(False).alias("_is_end")),
            F.struct(F.col("_e").alias("_at"), F.lit(True).alias("_is_end")),
        )),
    )
    share = F.when(F.col("_is_end"), F.col("_started_before")).otherwise(-F.col("_gone"))
    answers = bounds.join(sums, [*keys, "_at"]).groupBy(*keys, "_s", "_e").agg(
        F.sum(share).alias(name)
    )
    joined = windows.join(answers, [*keys, "_s", "_e"], "left")
    return joined.select(*windows.columns, F.coalesce(F.col(name), F.lit(0)).alias(name))


def overlaps_any(
    windows: DataFrame, intervals: DataFrame, name: str, keys: Sequence[str] = (),
    bounds_from: DataFrame | None = None,
) -> DataFrame:
    """Add to each window whether any interval of its key overlaps it.

    Half the work of a sum: [s, e) is overlapped if, among the intervals that start before
    e, the latest end lies after s. One running maximum and one lookup answer that.
    """
    keys = list(keys)
    valid = F.col("_s") < F.col("_e")
    source = windows if bounds_from is None else bounds_from
    facts = intervals.filter(valid).select(
        *keys, F.col("_s").alias("_at"), F.col("_e").alias("_until")
    )
    marks = source.filter(valid).select(
        *keys, F.col("_e").alias("_at"), F.lit(None).cast("long").alias("_until")
    )
    latest = running(facts.unionByName(marks), "_at", {"_until": "max"}, keys).select(
        *keys, F.col("_at").alias("_e"), "_until_before"
    )
    found = valid & (F.col("_until_before") > F.col("_s"))
    return windows.join(latest, [*keys, "_e"], "left").select(
        *windows.columns, F.coalesce(found, F.lit(False)).alias(name)
    )


def active_at(slots: DataFrame, at: Column, longest_s: int | None = None) -> DataFrame:
    """Slots whose closed interval contains one instant.

    ``longest_s``, the longest duration that can be stored, bounds ``start`` on both sides,
    so that a scan can skip files and row groups.
    """
    found = slots.filter(
        (F.col("start") <= at) & at.between(F.col("start"), slot_end("start", "duration_s"))
    )
    if longest_s is not None:
        found = found.filter(F.col("start") >= slot_end(at, F.lit(-longest_s)))
    return found


def active_at_each(slots: DataFrame, instants: DataFrame, at: str = "at") -> DataFrame:
    """(instant, slot) rows for a table of instants: bucketed equi-join, then the closed test.
    A bucket is dealt into parts by slot, so that the calendar's length does not bound the tasks."""
    spread = in_buckets(
        with_bounds(slots).filter(F.col("_s") <= F.col("_e")),
        F.col("_s"), F.col("_e"), BUCKET_US, "_first",
    )
    ticks = instants.withColumn("_t", epoch_us(at)).withColumn(
        "_bucket", bucket(F.col("_t"), BUCKET_US)
    )
    return (
        _dealt(spread, ticks)
        .filter(F.col("_t").between(F.col("_s"), F.col("_e")))
        .drop("_bucket", "_first", "_s", "_e", "_t")
    )


def starting_within(
    slots: DataFrame, refs: DataFrame, horizon_s: int = 1800, at: str = "at"
) -> DataFrame:
    """(reference time, slot) rows where the slot starts in [at, at + horizon], both closed."""
    width = max(1, horizon_s) * 1_000_000
    starts = slots.withColumn("_s", epoch_us("start")).withColumn(
        "_bucket", bucket(F.col("_s"), width)
    )
    ticks = refs.withColumn("_t", epoch_us(at))
    ticks = in_buckets(ticks, F.col("_t"), F.col("_t") + horizon_s * 1_000_000, width, "_first")
    return (
        _dealt(starts, ticks)
        .filter(F.col("_s").between(F.col("_t"), F.col("_t") + horizon_s * 1_000_000))
        .drop("_bucket", "_first", "_s", "_t")
    )


def islands(intervals: DataFrame, keys: Sequence[str], name: str = "_island") -> DataFrame:
    """Add the start of the chain of overlapping intervals that each row belongs to.

    A chain begins at a start where everything of the same key that started earlier has
    ended: a running maximum of the ends. The latest such start at or before a row is a
    running maximum again, over the same buckets. Rows need a valid ``_s`` < ``_e``.
    """
    keys = list(keys)
    starts = intervals.select(*keys, F.col("_s").alias("_at"), F.col("_e").alias("_until"))
    ends = running(starts, "_at", {"_until": "max"}, keys)
    is_head = F.coalesce(F.col("_until_before") <= F.col("_at"), F.lit(True))
    heads = ends.select(*keys, "_b", "_at", F.when(is_head, F.col("_at")).alias("_head"))
    latest = running(heads, "_at", {"_head": "max"}, keys).select(
        *keys, F.col("_at").alias("_s"), F.greatest("_head", "_head_before").alias(name)
    )
    return intervals.join(latest, [*keys, "_s"])
