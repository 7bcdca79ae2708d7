"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatwise.llm.common import cut_lineage, numbered

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEAT = 2
# Words per block.
BLOCK = 2048
# The sources are one small table; with more of them the shuffled join is used.
BROADCAST_ROWS = 50_000
# Cells of [0, 1) that sources and points are matched by.
CELLS = 4096
# The fraction of the golden ratio, whole and times 2^20 (its fractional part).
GOLDEN, GOLDEN_20 = 0.6180339887498949, 0.607787409740351
SEED = 8


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size: words of the whole text, null text 0. Written once."""
    count = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    return cut_lineage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        count.cast("long").alias("size"),
    ))


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = REPEAT
) -> DataFrame:
    """source, s (its number by code point, null last), source_size, target.

    The sources share ``share`` of all sizes by weight; none gets more than ``most`` times its
    size, and the excess goes to the others. With the sources ordered by the level at which they
    are full, the full ones come first, so that running sums give the common level at once. These windows
    run over one row per source, the only data here that is not dealt out.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("s", (F.row_number().over(by_name) - 1).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("full", most * F.col("source_size"))
    order = Window.orderBy(F.col("full") / F.col("w"), "s")
    every = Window.partitionBy()
    left = share * F.sum("source_size").over(every) - (F.sum("full").over(order) - F.col("full"))
    per = per.withColumn("level", left / (F.sum("w").over(every) - F.sum("w").over(order) + F.col("w")))
    is_full = F.col("full") <= F.col("level") * F.col("w")
    common = F.max(F.when(~is_full, F.col("level"))).over(every)
    target = F.when(is_full, F.col("full").cast("double")).otherwise(F.col("w") * common)
    return per.select("source", "s", "source_size", target.alias("target"))


def _quota() -> F.Column:
    return F.round("target").cast("long")


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """late, slot, s, block: the order in which blocks of the sources are taken.

    Point i of the golden-ratio sequence falls into one source's part of [0, 1), the parts being
    as long as the targets. The r-th slot of a source takes its block r, until its target is met;
    the few blocks that are then still missing come last (``late`` = 1, slots after all others; those of
    several sources can share one). Ranks are counted inside
    runs of 2^16 slots, with one row per source and run above them.
    """
    total = F.sum("quota").over(Window.partitionBy())
    per = plan.select("s", _quota().alias("quota")).filter("quota > 0")
    per = per.withColumn("blocks", F.ceil(F.col("quota") / block))
    to = F.sum("quota").over(Window.orderBy("s"))
    per = per.select("s", "blocks", (to / total).alias("to"), ((to - F.col("quota")) / total).alias("from"))
    per = per.withColumn("last", F.col("to") >= 1)
    n = per.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    cell = lambda x: F.floor(F.least(x, F.lit(1.0)) * CELLS)
    parts = per.withColumn("cell", F.explode(F.sequence(cell(F.col("from")), cell(F.col("to")))))
    frac = lambda x: x - F.floor(x)
    point = frac(frac(F.floor(F.col("id") / (1 << 20)) * GOLDEN_20) + frac(F.col("id") % (1 << 20) * GOLDEN))
    points = plan.sparkSession.range(n).select(F.col("id").alias("slot"), point.alias("x"))
    points = points.withColumn("cell", cell(F.col("x")))
    inside = (F.col("x") >= F.col("from")) & ((F.col("x") < F.col("to")) | F.col("last"))
    slots = points.join(parts, "cell").filter(inside).select("slot", "s", "blocks", F.shiftright("slot", 16).alias("run"))
    runs = slots.groupBy("s", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("s").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = runs.select("s", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    in_run = F.row_number().over(Window.partitionBy("s", "run").orderBy("slot")) - 1
    ranked = slots.withColumn("r", in_run).join(base, ["s", "run"])
    ranked = ranked.select(F.lit(0).alias("late"), "slot", "s", (F.col("r") + F.col("base")).alias("block"), "blocks")
    got = runs.groupBy("s").agg(F.sum("n").alias("got"))
    short = per.join(got, "s", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < blocks")
    missing = F.explode(F.sequence(F.col("got"), F.col("blocks") - 1)).alias("block")
    rest = short.select(F.lit(1).alias("late"), "s", missing)
    rest = rest.select("late", (n + F.col("block")).cast("long").alias("slot"), "s", "block")
    return ranked.filter("block < blocks").drop("blocks").unionByName(rest)


def placed(sizes: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, s, source_size, target, cell, rn, start: where a document begins in its
    source's stream, whose order is shuffled by a hash. Sums run inside cells of the hash."""
    n = sizes.count()
    cells = 1 << max(0, min(20, (n // 2000).bit_length()))
    few = plan.count() <= BROADCAST_ROWS
    plan = plan.withColumnRenamed("source", "_source")
    docs = sizes.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("_source")))
    docs = docs.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size"))
    docs = docs.withColumn("cell", F.pmod("h", F.lit(cells)))
    sums = docs.groupBy("s", "cell").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("s", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("s", "cell").orderBy("h", "doc_id", "size")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    docs = docs.withColumn("at", upto).withColumn("rn", F.row_number().over(order))
    return docs.join(base, ["s", "cell"]).select(
        "doc_id", "size", "s", "source_size", "target", "cell", "rn", (F.col("at") + F.col("base")).alias("start")
    )


def _pieces(
    docs: DataFrame, weights: Sequence[float], share: float, most: int, block: int, seed: int
) -> DataFrame:
    """Each document's words in each block of its source's stream, with the block's slot (null: not taken). A document
    without words has one row with no block."""
    sizes = sized(docs)
    plan = cut_lineage(targets(sizes, weights, share, most))
    slots = schedule(plan, block).select("s", "block", "slot")
    rows = placed(sizes, plan, seed)
    copies = []
    for epoch in range(most):
        low = F.col("start") + epoch * F.col("source_size")
        copies.append(F.struct(low.alias("low"), F.least(low + F.col("size"), _quota()).alias("high")))
    pieces = rows.withColumn("copy", F.explode(F.array(*copies)))
    some = F.col("copy.high") > F.col("copy.low")
    whole = F.sequence(F.floor(F.col("copy.low") / block), F.floor((F.col("copy.high") - 1) / block))
    pieces = pieces.withColumn("block", F.explode_outer(F.when(some, whole)))
    first = F.greatest("copy.low", F.col("block") * block) - F.col("copy.low")
    past = F.least("copy.high", (F.col("block") + 1) * block) - F.col("copy.low")
    pieces = pieces.withColumn("from", first).withColumn("to", past).drop("copy")
    return pieces.join(slots, ["s", "block"], "left")


def mixed_stream(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = REPEAT,
    block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """slot, s, block, doc_id, from, to: the mixture itself, as runs of words (``from`` to before ``to``) of documents.
    Sorted by slot, s and block, any stretch of it holds the sources close to their weights."""
    taken = _pieces(docs, weights, share, most, block, seed).filter(F.col("slot").isNotNull())
    return taken.select("slot", "s", "block", "doc_id", "from", "to")


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = REPEAT,
    block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), first_slot: one row per document.

    A source's stream is its documents in shuffled order, ``most`` times over, cut into blocks of
    ``block`` words and at its target; the last block may be shorter. The schedule gives the
    blocks their slots; a document's words in blocks that have one are taken, and the smallest of those slots says when the mixture
    first comes to it (null: never). Empty and null texts take 0, an
    empty table gives no rows, a null source is a source, repeated rows count one by one. The
    same rows and seed give the same result.
    """
    taken = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("to") - F.col("from"))), F.lit(0)).alias("taken")
    met = _pieces(docs, weights, share, most, block, seed)
    return met.groupBy("s", "cell", "rn", "doc_id", "size", "source_size", "target").agg(
        taken, F.min("slot").alias("first_slot")
    ).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


MIXED = ("size", "source_size", "target", "taken", "first_slot")


def with_mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the columns MIXED, which replace columns of these names."""
    held = numbered(docs, "mixing")
    mixed = mix(held.select(F.col("n").alias("doc_id"), "row.source", "row.text"))
    own = [c for c in docs.columns if c not in MIXED]
    return held.join(mixed.withColumnRenamed("doc_id", "n"), "n").select(*[f"row.`{c}`" for c in own], *MIXED)
