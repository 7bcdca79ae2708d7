"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import fold_out, stored
from seatwise.operators.keys import assign_ids
from seatwise.workspace import new_folder

BITS = 15
ORDERS = (1, 2, 3)
SMOOTH = 0.5
HELD_MOD, HELD_REST = 4, 2
UNKNOWN = "und"
# Cells of a broadcast matrix (languages x features), 4 bytes each. More languages are dealt into blocks, each with
# a matrix and a pass over the texts of its own.
CELLS = 1 << 25
# Languages whose counts a task holds at a time.
HELD = 64

_LATIN = re.compile("[A-Za-z]")
_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])
_ODD = np.uint32(0x9E3779B1)


def grams(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a text's letters in lower case; all else counts as a space."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(points, 0xFFFF)
    points = np.where((points > 0xFFFF) | _LETTER[low], points, np.uint32(32))
    counts, h = np.zeros(1 << BITS, np.int64), np.zeros(len(points), np.uint32)
    for n in range(max(ORDERS)):
        h = (h[: len(points) - n] + points[n:] + np.uint32(n)) * _ODD
        h ^= h >> np.uint32(15)
        if n + 1 in ORDERS:
            counts += np.bincount((h * _ODD) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_LATIN.search(text)) or any(map(str.isalpha, text)))


class Model:
    """Log probabilities of a block of languages: a row per feature, a column per language."""

    def __init__(self, languages: list[str], prior: np.ndarray, table: np.ndarray):
        self.languages, self.prior, self.table = languages, prior, table

    def best(self, text: str | None) -> tuple[str | None, float, float]:
        """The language, its joint log probability up to a constant of the corpus, and the sum of all joint
        probabilities of the block relative to it."""
        if not self.languages or not has_letter(text):
            return None, -np.inf, 0.0
        counts = grams(text)
        at = np.flatnonzero(counts)
        joint = self.prior + counts[at].astype(np.float64) @ self.table[at]
        best = int(joint.argmax())
        return self.languages[best], float(joint[best]), float(np.exp(joint - joint[best]).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        lang, _, total = self.best(text)
        return (UNKNOWN, 0.0) if lang is None else (lang, 1 / total)


_COUNTED = pa.schema([("lang", pa.string()), ("docs", pa.int64()), ("feature", pa.int32()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language: its documents (feature -1) and n-grams. It emits
    and starts anew when it holds HELD languages."""
    held: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}

    def out():
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            feature = np.r_[-1, at].astype(np.int32)
            rows = [[lang] * len(feature), np.r_[docs[lang], np.zeros(len(at), np.int64)], feature, np.r_[0, counts[at]]]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, _COUNTED.types)], schema=_COUNTED)
        held.clear()
        docs.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            lang = lang.as_py()
            if lang not in held:
                if len(held) >= HELD:
                    yield from out()
                held[lang], docs[lang] = np.zeros(1 << BITS, np.int64), 0
            held[lang] += grams(text.as_py() or "")
            docs[lang] += 1
    yield from out()


def learn(docs: DataFrame) -> Iterator[Broadcast]:
    """Counts of all rows of ``docs(text, lang)`` with a language, as matrices of bounded size: one, or, with more
    languages than fit, one per block of languages in the order of their code points. No more than a block's counts
    and languages come to the driver."""
    spark = docs.sparkSession
    rows = docs.filter(F.col("lang").isNotNull()).select("lang", "text")
    counts = rows.mapInArrow(_count, "lang string, docs long, feature int, n long")
    counts = stored(counts.groupBy("lang", "feature").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")), "grams")
    languages = counts.filter("feature = -1").select("lang")
    size = max(1, CELLS >> BITS)
    n = languages.count()
    if n <= size:
        yield spark.sparkContext.broadcast(_model(counts))
        return
    numbers = assign_ids(languages, "number", ["lang"]).select("lang", F.floor((F.col("number") - 1) / size).alias("block"))
    path = new_folder(spark, "language-blocks")
    counts.join(numbers, "lang").repartition("block", "lang").write.partitionBy("block").parquet(path)
    for block in range(-(-n // size)):
        yield spark.sparkContext.broadcast(_model(spark.read.parquet(path).filter(F.col("block") == block)))


def _model(counts: DataFrame) -> Model:
    found = counts.select("lang", "feature", "docs", "n").toArrow()
    lang = found.column("lang").combine_chunks().dictionary_encode()
    names = lang.dictionary.to_pylist()
    languages = sorted(names)
    place = {name: i for i, name in enumerate(languages)}
    column = np.array([place[name] for name in names], np.int64)[lang.indices.to_numpy()]
    feature, docs_n, n = (found.column(c).to_numpy() for c in ("feature", "docs", "n"))
    table = np.full((1 << BITS, len(languages)), SMOOTH)
    seen = feature >= 0
    table[feature[seen], column[seen]] += n[seen]
    prior = np.bincount(column, docs_n, minlength=len(languages)) + 1.0
    return Model(languages, np.log(prior), np.log(table / table.sum(axis=0)).astype(np.float32))


def predict_column(text: str, model: Broadcast) -> Column:
    """struct(lang, joint, total), as ``Model.best`` gives them."""
    @F.pandas_udf("lang string, joint double, total double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(map(model.value.best, texts), columns=["lang", "joint", "total"])

    return predict(F.col(text))


def _joined(docs: DataFrame, models: Iterator[Broadcast], first: Broadcast) -> DataFrame:
    """doc_id, held_out, p: the best of all blocks. Each block's answers are written before the next block's
    matrix is made, and a row's answers, one per block, meet in one shuffle."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias("n"), "doc_id", "held_out", "text"), "texts")
    answers = []
    for block, model in enumerate(chain([first], models)):
        answer = rows.select("n", F.lit(block).alias("block"), predict_column("text", model).alias("p"))
        answers.append(stored(answer.filter("p.lang is not null").select("n", "block", "p.*"), "answers"))
        model.destroy()
    # Blocks follow the code points, so among equals the smallest block has the first language.
    best = F.max(F.struct("joint", (-F.col("block")).alias("block"), "lang"))
    both = reduce(DataFrame.unionByName, answers).groupBy("n").agg(
        best.alias("b"), F.collect_list(F.struct("joint", "total")).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda sum_, p: sum_ + p.total * F.exp(p.joint - F.col("b.joint")))
    p = F.struct(F.col("b.lang").alias("lang"), F.col("b.joint").alias("joint"), total.alias("total"))
    return rows.drop("text").join(both.select("n", p.alias("p")), "n", "left").drop("n")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of ``docs(doc_id, text, lang)``.

    Learns from rows that are not held out and have a language. A null text or one without any
    letter is ``und`` with score 0, and so is every text if there is nothing to learn from. The score is
    the posterior probability of the predicted language; ties go to the first by code point. Any number of
    languages: those beyond one matrix take further passes over the texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    docs = docs.withColumn("held_out", fold_out("doc_id", HELD_MOD, HELD_REST))
    models = learn(docs.filter(~F.col("held_out")))
    first, second = next(models), next(models, None)
    if second is None:
        found = docs.select("doc_id", "held_out", predict_column("text", first).alias("p"))
    else:
        found = _joined(docs, chain([second], models), first)
    return found.select(
        "doc_id", "held_out", F.coalesce("p.lang", F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("p.lang").isNull(), 0.0).otherwise(1 / F.col("p.total")).alias("score"),
    )
