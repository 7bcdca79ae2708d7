"""How a chain of filters interacts: what each of them removes at each place of every order."""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.llm.common import cut_lineage, stored

LETTERS = "ABCDE"
SPACE = " \t\n\x0b\x0c\r"
# The limits of the filters.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 200, 50, 3, r"[#$%&*|]"


def _bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def own_failures(text: str) -> Column:
    """Bits of the filters that a text fails by itself (A to D); null counts as empty.

    A: under 200 words; B: under half of the words are distinct; C: over 3 % of the code points
    are A-Z; D: holds one of ``#$%&*|``. Words are runs of anything but space and 09-0D, case-sensitive.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(whole, F.lit(SPACE))
    words = F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    size = F.char_length(whole)
    capitals = size - F.char_length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = {
        "A": n < MIN_WORDS, "B": 100 * distinct < MIN_DISTINCT * n,
        "C": 100 * capitals.cast("long") > MAX_CAPITALS * size, "D": whole.rlike(MARKS),
    }
    return sum((F.when(f, _bit(k)).otherwise(0) for k, f in fails.items()), F.lit(0)).cast("int")


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, n_good, n_toxic: documents per language and set of failed filters.

    Filter E fails a document whose text some smaller doc_id also has; a null doc_id is neither
    smaller nor larger. Rows are folded per document id and text before anything is joined, so that a
    repeated id or text does not pile up: texts meet by their digest, as one row per digest that
    has several ids, on the side that adaptive execution can split. Of several label rows
    of an id any counts. Written once: a row per language and mask, whatever the number of documents.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), own_failures("text").alias("own"),
    ).groupBy("doc_id", "part", "digest", "own").agg(F.count("*").alias("n"))
    rows = stored(rows, "filter-rows")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = firsts.filter(F.col("first") < F.col("last")).drop("last")
    repeats = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    judged = rows.join(marks, "doc_id", "left").join(firsts, "digest", "left").withColumn(
        "mask", F.col("own") + F.when(repeats, _bit("E")).otherwise(0)
    )
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return cut_lineage(judged.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), of("good").alias("n_good"), of("toxic").alias("n_toxic")
    ))


def prefixes(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """prefix, letter, step, mask, alive, fails, alone: every order of up to all filters, against every mask.

    A recursive CTE: it starts with the masks and no filter, and each level appends each letter whose
    bit is not yet applied. A level's rows say, for the filter that it applies, whether a document
    with that mask is still there (``alive``), fails, and fails nothing else (``alone``). The number of
    rows depends on the number of filters only: 325 prefixes x 32 masks for five.
    """
    unused = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(letters))
    walked = spark.sql(f"""
        WITH RECURSIVE walk(prefix, letter, step, applied, mask, alive, fails, alone) AS (
          SELECT '', '', 0, 0, CAST(id AS INT), true, false, false FROM range({1 << len(letters)})
          UNION ALL
          SELECT prefix || f.letter, f.letter, step + 1, applied | f.bit, mask,
                 (mask & applied) = 0, (mask & f.bit) <> 0, mask = f.bit
          FROM walk LATERAL VIEW explode(filter(array({unused}), x -> (applied & x.bit) = 0)) AS f
        )
        SELECT prefix, letter, step, mask, alive, fails, alone FROM walk WHERE step > 0
    """)
    return stored(walked, "filter-prefixes")


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, the COUNTS and shapley, for every part of ``cells``, order and step.

    kept: left after the step; removed: failing here, not removed before; redundant: failing here,
    removed before; unique_fails: failing this filter only; good_lost and toxic_lost: of those removed,
    labelled so; shapley: what this filter removes, summed over all orders. A prefix of k filters begins
    (number of filters - k)! orders, so sums over prefixes give those over orders. Prefixes and orders are tables of
    fixed size and are broadcast; masks meet by equality. No rows in, no rows out.
    """
    walked = F.broadcast(prefixes(cells.sparkSession, letters))
    when = lambda c, n="n": F.sum(F.when(c, F.col(n)).otherwise(0)).cast("long")
    alive, fails = F.col("alive"), F.col("fails")
    steps = cut_lineage(cells.select("part", "mask", "n", "n_good", "n_toxic").join(walked, "mask").groupBy(
        "part", "prefix", "letter", "step"
    ).agg(
        when(alive & ~fails).alias("kept"), when(alive & fails).alias("removed"),
        when(~alive & fails).alias("redundant"), when(F.col("alone")).alias("unique_fails"),
        when(alive & fails, "n_good").alias("good_lost"), when(alive & fails, "n_toxic").alias("toxic_lost"),
    ))
    orders_after = F.element_at(
        F.array(*[F.lit(factorial(len(letters) - k)) for k in range(1, len(letters) + 1)]), F.col("step")
    )
    shares = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders_after).cast("long").alias("shapley"))
    whole = walked.filter(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    orders = whole.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("_step"))
    orders = orders.select("filter_order", F.expr("substring(filter_order, 1, _step)").alias("prefix"))
    return steps.join(shares, ["part", "letter"]).join(F.broadcast(orders), "prefix").select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), *COUNTS, "shapley"
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the five filters over whole texts, a part for each language (null: empty string).

    Empty and null texts fail A alone (and E, if a smaller doc_id has one too); repeated rows count each; an
    empty table gives no rows; further columns play no part.
    """
    return audit(mask_cells(docs, labels))
