"""Sequential admission of a batch of slots.

Inserting slots one by one is order-dependent: an accepted slot blocks its table for the
ones after it, uses up its booking and fills the restaurant. The same answer comes from sets:

* Only slots whose intervals chain together on one table affect each other. Such chains
  (islands) are judged side by side, each in arrival order.
* In a long island whose slots arrive in the order of time (or against it) each admitted slot
  leads to the next one that does not overlap it. What is reached from the first
  is found by pointer doubling: steps grow with the logarithm of the island's length.
* Of any other island longer than ``BLOCK`` rows the first ``BLOCK`` arrivals are judged. Everything
  that overlaps a slot admitted there is refused by a join, and what is left goes into the
  next round, where it usually falls apart into short islands. No group larger than
  ``BLOCK`` is ever gathered, and nothing is dropped: rounds go on until all are decided.
* A candidate whose booking has an earlier candidate still open waits; so do later
  candidates that would overlap it.
* With a capacity, who fits beside all open people, earlier or later, is free of the rule. For the others every round knows two sets around the people admitted before a candidate: at least those
  admitted so far, at most those and all open ones. Who does not fit beside the first set is refused,
  who fits beside the second is free of the rule, and who is in between waits. The sets grow together.
* The earliest open candidate never waits, so every round decides at least that one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatwise.functions.columns import CANCELLED, OCCUPIED, RESERVED, overlaps
from seatwise.operators.intervals import BUCKET_US, in_buckets, islands, overlap_sum, overlaps_any, with_bounds
from seatwise.operators.keys import assign_ids
from seatwise.operators.rules import (
    _judge, booking_has_slot_rule, over_capacity_rule, placement_rules, slot_invalid_rule, stored_slots,
    table_overlap_rule, valid_slot, with_placement, with_stored_conflicts,
)
from seatwise.operators.running import running
from seatwise.workspace import cut_lineage, written

# Rows of one island judged together per round. Spark prunes row_number() <= 1000 before
# the shuffle (its default window group limit), so hot islands are cut on the map side.
BLOCK = 1000

ADMIT, REFUSE, WAIT = "admit", "refuse", "wait"


def _verdicts(block: DataFrame) -> DataFrame:
    """Walk each island's block in arrival order; adds ``_verdict``.

    A slot is refused if it overlaps an admitted one, waits if it or an overlapping
    earlier one waits, and is admitted otherwise. Cancelled slots block nobody.
    """
    fields = ("_rank", "_s", "_e", "_blocks", "_waits", "slot_id", "table_id", "booking_id")
    item = F.struct(*fields)

    def step(done: Column, x: Column) -> Column:
        def meets(verdict: str) -> Column:
            return F.exists(done, lambda d: (
                (d["_verdict"] == verdict) & d["_blocks"]
                & (d["_s"] < x["_e"]) & (x["_s"] < d["_e"])
            ))

        verdict = (
            F.when(meets(ADMIT), REFUSE).when(x["_waits"] | meets(WAIT), WAIT).otherwise(ADMIT)
        )
        return F.concat(done, F.array(F.struct(
            *[x[f].alias(f) for f in fields], verdict.alias("_verdict")
        )))

    kind = dict(block.dtypes)
    done_type = "array<struct<" + ",".join(
        [f"{f}:{kind[f]}" for f in fields] + ["_verdict:string"]
    ) + ">>"
    walked = block.groupBy("table_id", "_island").agg(
        F.sort_array(F.collect_list(item)).alias("_items")
    )
    walked = walked.select(
        F.aggregate("_items", F.array().cast(done_type), step).alias("_done")
    )
    return walked.select(F.inline("_done"))


def _overlapped(rest: DataFrame, admitted: DataFrame) -> DataFrame:
    """Ids of ``rest`` that overlap an earlier admitted slot of their table.

    Admitted slots of a table never overlap each other, so few of them share a bucket. Rows of
    ``rest`` can have any length; they are first cut to the time in which their table
    has admitted slots, so that a senseless duration does not unfold beyond that.
    """
    used = admitted.groupBy("table_id").agg(F.min("_s").alias("_open"), F.max("_e").alias("_shut"))
    near = rest.join(used, "table_id").withColumn("_low", F.greatest("_s", "_open")).withColumn(
        "_high", F.least("_e", "_shut")
    ).filter(F.col("_low") < F.col("_high"))
    a = in_buckets(near, F.col("_low"), F.col("_high") - 1, BUCKET_US, "_first").select(
        "table_id", "_bucket", "slot_id", "_rank", "_s", "_e"
    )
    b = in_buckets(
        admitted.filter("_blocks"), F.col("_s"), F.col("_e") - 1, BUCKET_US, "_first"
    ).select(
        "table_id", "_bucket", F.col("_rank").alias("_rank_2"),
        F.col("_s").alias("_s_2"), F.col("_e").alias("_e_2"),
    )
    hit = overlaps(F.col("_s"), F.col("_e"), F.col("_s_2"), F.col("_e_2"))
    return (
        a.join(b, ["table_id", "_bucket"])
        .filter(hit & (F.col("_rank_2") < F.col("_rank")))
        .select("slot_id").distinct()
    )


def earlier_sum(windows: DataFrame, intervals: DataFrame, name: str, n: int) -> DataFrame:
    """Add to each window the people of all ``intervals`` that overlap it and come before it.

    Both sides carry ``_no``, their place in the order of arrival (below ``n``). Of two places the smaller one has
    a 0 where they first differ in binary and the larger one a 1. So each interval goes under the prefix of
    each of its zeros, each window under that of each of its ones, and per prefix the answer is a sum over time:
    log(n) rows for each row, and never a pair.
    """
    levels = F.array(*[F.lit(k) for k in range(max(1, (n - 1).bit_length()))])

    def placed(df: DataFrame, bit: int, *columns: str) -> DataFrame:
        at = df.select("_no", "_s", "_e", *columns, F.explode(levels).alias("_level"))
        at = at.filter(F.expr("shiftright(_no, _level) % 2") == bit)
        return at.select(*columns, "_s", "_e", "_level", F.expr("shiftright(_no, _level + 1)").alias("_prefix"))

    asked = placed(windows.withColumn("_who", F.col("_no")), 1, "_who").withColumnRenamed("_who", "_no")
    told = placed(intervals.filter(F.col("_people") > 0), 0, "_people")
    parts = overlap_sum(asked, told, "_people", "_part", ["_level", "_prefix"])
    sums = parts.groupBy("_no").agg(F.sum("_part").cast("long").alias(name))
    return windows.join(sums, "_no", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("long")))


def _near(intervals: DataFrame, windows: DataFrame) -> DataFrame:
    """The intervals with people that overlap any of the windows."""
    return overlaps_any(intervals.filter(F.col("_people") > 0), windows, "_met").filter("_met").drop("_met")


def _earlier_where_full(windows: DataFrame, intervals: DataFrame, name: str, n: int, total: int) -> DataFrame:
    """``earlier_sum`` for the windows that would be too full beside all ``intervals``, earlier or later; the others fit
    whatever came before them and get 0. The logarithm is only paid where the restaurant is nearly full."""
    people = intervals.filter(F.col("_people") > 0)
    rows = overlap_sum(windows, people, "_people", "_all")
    rows = rows.withColumn("_full", F.col("_low") + F.col("_all") + F.col("party_size") > total).drop("_all")
    rows = written(rows, "beside")
    full = rows.filter("_full").select("_no", "_s", "_e")
    rows = rows.drop("_full")
    if full.isEmpty():
        return rows.withColumn(name, F.lit(0).cast("long"))
    sums = earlier_sum(full, _near(people, full), name, n).select("_no", name)
    return rows.join(sums, "_no", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("long")))


def _ordered_islands(left: DataFrame, block_size: int) -> DataFrame | None:
    """(table_id, _island, _forward): islands of more than ``block_size`` rows in which nothing waits and slots that block the
    table arrive in the order of their starts, or the other way round in the order of their ends."""
    keys = ["table_id", "_island"]
    large = left.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_waits").alias("_any_waits"))
    large = cut_lineage(large.filter((F.col("_n") > block_size) & ~F.col("_any_waits")).select(*keys))
    if large.isEmpty():
        return None
    left = left.join(large, keys, "left_semi")
    rows = left.filter("_blocks").select(
        *keys, F.shiftleft("_no", 12).alias("_at"), F.col("_s").alias("_start"), (-F.col("_e")).alias("_back")
    )
    before = running(rows, "_at", {"_start": "max", "_back": "max"}, keys)
    kept = lambda c: F.coalesce(F.min(F.coalesce(F.col(f"{c}_before") <= F.col(c), F.lit(True))), F.lit(True))
    orders = before.groupBy(*keys).agg(kept("_start").alias("_forward"), kept("_back").alias("_backward"))
    return orders.filter("_forward or _backward").select(*keys, "_forward")


def _reached(chains: DataFrame) -> tuple[DataFrame, int]:
    """Slots admitted in islands that arrive in order, and the number of doubling steps.

    ``chains`` has the blocking slots with ``_a``, ``_z``: start and end along the direction of arrival. Slots that
    begin together are one node, of which the first to arrive counts. A node leads to the first one that
    begins at or after its end.
    """
    keys = ["table_id", "_island"]
    nodes = chains.groupBy(*keys, "_a").agg(F.min(F.struct("_no", "_z")).alias("_first")).select(
        *keys, "_a", F.col("_first._no").alias("_no"), F.col("_first._z").alias("_z"))
    # The earliest beginning at or after an end: a running maximum over time turned round.
    points = nodes.select(*keys, (-F.col("_a")).alias("_at"), (-F.col("_a")).alias("_v")).unionByName(
        nodes.select(*keys, (-F.col("_z")).alias("_at"), F.lit(None).cast("long").alias("_v")))
    found = running(points, "_at", {"_v": "max"}, keys).select(
        *keys, (-F.col("_at")).alias("_z"), (-F.greatest("_v", "_v_before")).alias("_next"))
    first = nodes.groupBy(*keys).agg(F.min("_a").alias("_head"))
    nodes = nodes.join(found, [*keys, "_z"]).join(first, keys)
    nodes = written(nodes.select(*keys, "_a", "_no", "_next", (F.col("_a") == F.col("_head")).alias("_on")), "chain")
    steps = 0
    while True:
        steps += 1
        ahead = nodes.select(*keys, F.col("_a").alias("_next"), F.col("_next").alias("_over"))
        marked = nodes.filter(F.col("_on") & F.col("_next").isNotNull()).select(
            *keys, F.col("_next").alias("_a"), F.lit(True).alias("_hit"))
        nodes = written(nodes.join(ahead, [*keys, "_next"], "left").join(marked, [*keys, "_a"], "left").select(
            *keys, "_a", "_no", F.col("_over").alias("_next"),
            (F.col("_on") | F.coalesce(F.col("_hit"), F.lit(False))).alias("_on")), "chain")
        # Once no node that is on leads anywhere, all are found: 2^steps nodes of each island are.
        if nodes.filter(F.col("_on") & F.col("_next").isNotNull()).isEmpty():
            return nodes.filter("_on").select("_no"), steps


def _decide(
    candidates: DataFrame, block_size: int, n: int, total: int | None, rounds: list[int] | None = None
) -> DataFrame:
    """Admitted rows of ``candidates`` (checkpointed; unique ``slot_id``, ``_rank`` and ``_no``, which is below
    ``n``). ``rounds``, if given, gets for each round the number of doubling steps in it.

    With ``total`` the rows carry ``_low``, the people stored beside them; it grows by those admitted.
    """
    left, n_left = candidates, candidates.count()
    admitted = [candidates.limit(0)]
    columns = candidates.columns
    while n_left:
        if total is not None:
            left = _earlier_where_full(left, left, "_open", n, total)
            over = F.col("_low") + F.col("party_size") > total
            fits = F.col("_low") + F.col("_open") + F.col("party_size") <= total
            left = written(left.filter(~over).withColumn("_unsure", ~fits).drop("_open"), "open")
            n_left = left.count()
            if not n_left:
                break
        # Bookings are checked for repeats among open rows only; usually there are none.
        repeats = left.groupBy("booking_id").agg(
            F.min("_rank").alias("_first_rank"), F.count("*").alias("_n")
        ).filter(F.col("_n") > 1).drop("_n")
        waits = F.coalesce(F.col("_rank") > F.col("_first_rank"), F.lit(False))
        if total is not None:
            waits = waits | F.col("_unsure")
        place = F.row_number().over(Window.partitionBy("table_id", "_island").orderBy("_rank"))
        ready = islands(left, ["table_id"]).join(repeats, "booking_id", "left").withColumn("_waits", waits)
        steps = 0
        if n_left > block_size:
            ready = written(ready, "ready")
            ordered = _ordered_islands(ready, block_size)
            if ordered is not None:
                ordered = cut_lineage(ordered)
                chains = ready.filter("_blocks").join(ordered, ["table_id", "_island"]).withColumn(
                    "_a", F.when(F.col("_forward"), F.col("_s")).otherwise(-F.col("_e"))
                ).withColumn("_z", F.when(F.col("_forward"), F.col("_e")).otherwise(-F.col("_s")))
                on, steps = _reached(chains)
                chained = ready.join(on, "_no", "left_semi").withColumn("_verdict", F.lit(ADMIT))
                ready = ready.join(ordered, ["table_id", "_island"], "left_anti")
        block = ready.withColumn("_place", place).filter(F.col("_place") <= block_size)
        fields = ["_rank", "_s", "_e", "_blocks", "_waits", "slot_id", "table_id", "booking_id", "_verdict"]
        judged = _verdicts(block)
        if steps:
            judged = judged.select(fields).unionByName(chained.select(fields))
        judged = written(judged, "judged")
        if rounds is not None:
            rounds.append(steps)
        n_decided = judged.filter(F.col("_verdict") != WAIT).count()
        in_now = judged.filter(F.col("_verdict") == ADMIT).select("slot_id")
        new = left.join(in_now, "slot_id", "left_semi").select(*columns)
        admitted.append(new)
        if n_decided == n_left:
            break
        # Only now the next round is prepared; usually there is none.
        decided = judged.filter(F.col("_verdict") != WAIT).select("slot_id")
        rest = left.select(*columns).join(decided, "slot_id", "left_anti")
        used = new.groupBy("booking_id").agg(F.min("_rank").alias("_used_rank"))
        rest = rest.join(used.select("booking_id"), "booking_id", "left_anti")
        rest = rest.join(_overlapped(rest, new), "slot_id", "left_anti")
        if total is not None:
            rest = written(rest, "rest")
            rest = earlier_sum(rest, _near(new, rest), "_more", n).withColumn("_low", F.col("_low") + F.col("_more"))
        left = written(rest.select(*columns), "open")
        n_left = left.count()
    return reduce(lambda a, b: a.unionByName(b), admitted)


def admit_slots(
    candidates: DataFrame,
    existing: DataFrame,
    bookings: DataFrame,
    tables: DataFrame,
    arrival: list[str],
    block_size: int = BLOCK,
    total: Column | None = None,
    rounds: list[int] | None = None,
) -> DataFrame:
    """Candidates with ``rule`` and ``message``, as if inserted in ``arrival`` order.

    Rules: booking and table exist, the party fits, no overlap on the table with a stored
    or earlier admitted slot, one slot per booking. A cancelled candidate is judged but,
    once stored, blocks no table; it still uses up its booking. ``slot_id`` must be unique
    among the candidates; it also breaks ties of ``arrival``. A row without start or with a
    duration outside (0, 2 h] is never admitted; the other rules are reported before that.

    With ``total`` (a scalar, such as ``restaurant_seats``) the capacity of the whole restaurant is
    part of the sequence too, last but for an invalid start or duration: the people of all reserved
    or occupied bookings, stored or admitted before, whose slots overlap a candidate's, and its own party,
    whatever its status, must not exceed it. Without it run ``audit_capacity`` on existing plus admitted slots.
    """
    rank = F.struct(*[F.col(c) for c in arrival], F.col("slot_id"))
    timed = with_bounds(candidates)
    placed = with_placement(timed, bookings, tables).withColumn("_rank", rank)
    stored = stored_slots(existing, bookings)
    checked = with_stored_conflicts(placed, timed, stored)
    more = []
    if total is not None:
        live = stored.filter(F.col("status").isin(RESERVED, OCCUPIED))
        checked = overlap_sum(checked, live, "party_size", "_low", bounds_from=timed)
        more = ["_low", "party_size"]
    first = _judge(checked, checked.columns, [
        *placement_rules(),
        table_overlap_rule(F.col("_crossed")),
        booking_has_slot_rule(F.col("_slots") > 0),
    ])
    first = cut_lineage(assign_ids(first, "_no", ["_rank"]).withColumn("_no", F.col("_no").cast("long")))
    people = F.when(F.col("status").isin(RESERVED, OCCUPIED), F.col("party_size")).otherwise(0).cast("long")
    contest = first.filter(F.col("rule").isNull() & valid_slot()).select(
        "slot_id", "table_id", "booking_id", "_s", "_e", "_rank", "_no", *more,
        (F.col("status") != CANCELLED).alias("_blocks"), people.alias("_people"),
    )
    seats = None if total is None else candidates.sparkSession.range(1).select(total.alias("t")).first()["t"]
    n = first.count() + 1
    admitted = _decide(contest, block_size, n, seats, rounds)
    if total is not None:
        admitted = cut_lineage(admitted)
    # Which rule stopped a row depends on what was admitted before it; overlap comes first.
    open_to_batch = first.filter(F.col("rule").isNull() | (F.col("rule") == "booking_has_slot"))
    losers = open_to_batch.join(admitted.select("slot_id"), "slot_id", "left_anti")
    hits = _overlapped(losers, admitted).withColumn("_hit", F.lit(True))
    used = admitted.groupBy("booking_id").agg(F.min("_rank").alias("_used_rank"))
    final = first.drop("rule", "message").join(hits, "slot_id", "left").join(
        used, "booking_id", "left"
    )
    full = []
    if total is not None:
        asked = losers.select("slot_id", "_no", "_s", "_e", "_low", "party_size")
        beside = _earlier_where_full(asked, admitted, "_more", n, seats).select("slot_id", "_more")
        # Only of rows that were not admitted is asked whether they fitted.
        final = final.join(beside, "slot_id", "left").withColumn("_taken", F.col("_low") + F.col("_more"))
        full = [over_capacity_rule(F.col("_taken"), F.lit(seats))]
    return _judge(final, candidates.columns, [
        *placement_rules(),
        table_overlap_rule(F.col("_crossed") | F.col("_hit")),
        booking_has_slot_rule((F.col("_slots") > 0) | (F.col("_used_rank") < F.col("_rank"))),
        *full,
        slot_invalid_rule(),
    ])


def restaurant_seats(tables: DataFrame) -> Column:
    """Scalar: the seats of all tables, 0 without any."""
    return tables.agg(F.coalesce(F.sum("seats"), F.lit(0))).scalar()
