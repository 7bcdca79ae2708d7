"""Quality classifier: a factorisation machine over hashed words, structure and length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import fold_out, ids_and_text, words

# Labelled documents of each class that the machine is fitted on.
SAMPLE = 3000
HELD_MOD, HELD_REST = 5, 0
THRESHOLD = 0.3
WORDS = 1 << 15
RANK = 8
_SHARES = np.array([0.001, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.97])
_BINS = len(_SHARES) + 1
_STATS = 16
SIZE = WORDS + _STATS * _BINS


def _share(n: float, of: float) -> float:
    return n / of if of else 0.0


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values: words (square roots of counts, to length 1) and one bin per statistic.
    An empty text has the statistics alone."""
    tokens = words(text)
    hashes = np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens))
    at, n = np.unique(hashes & np.uint32(WORDS - 1), return_counts=True)
    value = np.sqrt(n)
    value = value / np.sqrt((value**2).sum()) if len(value) else value
    octet = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, count = len(text), len(tokens)
    upper, lower, digits = octet[65:91].sum(), octet[97:123].sum(), octet[48:58].sum()
    high, blank, breaks = octet[128:].sum(), octet[32] + octet[9:14].sum(), octet[10]
    marks = size - upper - lower - digits - high - blank
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = (hashes[1:].astype(np.uint64) << np.uint64(32)) | hashes[:-1]
    kinds, times = np.unique(hashes, return_counts=True)
    stats = (
        _share(upper, upper + lower), _share(digits, size), _share(marks, size), _share(high, size),
        _share(blank, size), _share(len(kinds), count), _share(times.max(initial=0), count),
        _share((hashes[1:] == hashes[:-1]).sum(), count - 1 if count > 1 else 0),
        _share(len(np.unique(pairs)), len(pairs)), _share(len(set(lines)), len(lines)),
        _share(octet[46] + octet[44], marks), min(1.0, np.log2(1 + count) / 16),
        min(1.0, _share(size, count) / 20), min(1.0, _share(breaks, count) * 4),
        min(1.0, _share(octet[33] + octet[35] + octet[36] + octet[37] + octet[38] + octet[42], count)),
        min(1.0, np.log2(1 + len(lines)) / 12),
    )
    bins = np.searchsorted(_SHARES, np.array(stats), side="right") + np.arange(_STATS) * _BINS + WORDS
    return np.r_[at.astype(np.int64), bins], np.r_[value, np.full(_STATS, 0.5)]


class Machine:
    def __init__(self, bias: float, single: np.ndarray, factors: np.ndarray):
        self.bias, self.single, self.factors = bias, single, factors

    def margin(self, at: np.ndarray, value: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of ``rows`` documents and their factor sums. All pairs in linear time: half of the
        squared sum less the sum of squares. ``row`` is ascending, and each row has features."""
        start = np.searchsorted(row, np.arange(rows))
        terms = self.factors[at] * value[:, None]
        total = np.add.reduceat(terms, start, axis=0)
        squares = np.add.reduceat((terms**2).sum(axis=1), start)
        line = np.add.reduceat(self.single[at] * value, start)
        return self.bias + line + 0.5 * ((total**2).sum(axis=1) - squares), total

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        found = [features(t) for t in texts]
        row = np.repeat(np.arange(len(found)), [len(a) for a, _ in found])
        margin, _ = self.margin(np.concatenate([a for a, _ in found]), np.concatenate([v for _, v in found]), row, len(found))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray,
        epochs: int = 10, steps: int = 800, rate: float = 0.08, decay: float = 1e-5, seed: int = 9) -> Machine:
    """Logistic loss, AdaGrad on batches of 64, for ``epochs`` passes and ``steps`` batches at least. ``weights`` undo the balance of the sample. No rows or a
    single class: a constant, the smoothed share of good labels."""
    good = (weights * labels).sum()
    bias = float(np.log((good + 1) / (weights.sum() - good + 1)))
    rng = np.random.default_rng(seed)
    machine = Machine(bias, np.zeros(SIZE), np.zeros((SIZE, RANK)))
    if not len(labels) or labels.min() == labels.max():
        return machine
    machine.factors = rng.normal(0, 0.05, (SIZE, RANK))
    speed_1, speed_2, speed_0 = np.full(SIZE, 1e-3), np.full((SIZE, RANK), 1e-3), 1.0
    batches = max(1, len(rows) // 64)
    for _ in range(max(epochs, -(-steps // batches))):
        for part in np.array_split(rng.permutation(len(rows)), batches):
            at = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            row = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            margin, total = machine.margin(at, value, row, len(part))
            pull = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) * weights[part] / weights.mean() / len(part)
            uniq, where = np.unique(at, return_inverse=True)
            slope = pull[row] * value
            first = np.bincount(where, slope) + decay * machine.single[uniq]
            own = machine.factors[at]
            second = np.zeros((len(uniq), RANK))
            np.add.at(second, where, slope[:, None] * (total[row] - own * value[:, None]))
            second += decay * machine.factors[uniq]
            speed_0 += pull.sum() ** 2
            machine.bias -= rate * pull.sum() / np.sqrt(speed_0)
            speed_1[uniq] += first**2
            machine.single[uniq] -= rate * first / np.sqrt(speed_1[uniq])
            speed_2[uniq] += second**2
            machine.factors[uniq] -= rate * second / np.sqrt(speed_2[uniq])
    return machine


def features_column(text: str) -> Column:
    @F.pandas_udf("at array<int>, value array<float>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [features(t or b"") for t in texts]
            yield pd.DataFrame({"at": [a for a, _ in rows], "value": [v for _, v in rows]})

    return found(F.col(text))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Broadcast:
    """Fits on the ``sample`` documents of each class whose ids hash lowest, out of the labels that
    are not held out. Labels of one doc_id are averaged; null ids and labels are left out."""
    seen = labels.filter(~fold_out("doc_id", HELD_MOD, HELD_REST)).select("doc_id", "quality")
    seen = seen.dropna().groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    counts = {r.label: r.n for r in seen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    good, bad = (seen.filter(F.col("label") == k).orderBy(*order).limit(sample) for k in (1, 0))
    chosen = F.broadcast(good.union(bad))
    rows = ids_and_text(docs).join(chosen, "doc_id").select("doc_id", "label", features_column("text").alias("f"))
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("f").alias("f"))
    found = rows.select("doc_id", "label", "f.at", "f.value").toArrow().sort_by("doc_id")
    label = found.column("label").to_numpy()
    at, value = (found.column(c).combine_chunks() for c in ("at", "value"))
    cuts = at.offsets.to_numpy()
    at, value = at.values.to_numpy().astype(np.int64), value.values.to_numpy()
    inputs = [(at[i:j], value[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]
    weight = np.ones(len(label))
    for k in (0, 1):
        if (label == k).any():
            weight[label == k] = counts.get(k, 0) / (label == k).sum()
    return docs.sparkSession.sparkContext.broadcast(fit(inputs, label, weight))


def score_column(text: Column, machine: Broadcast) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [
                machine.value.scores([t or b"" for t in texts.iloc[i : i + 256]]) for i in range(0, len(texts), 256)
            ]
            yield pd.Series(np.concatenate([np.zeros(0), *parts]))

    return score(text)


def text_bytes(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs(doc_id, text)``. Null texts
    score as empty ones. Without labels every score is 0.5."""
    scored = ids_and_text(docs).select(
        "doc_id", fold_out("doc_id", HELD_MOD, HELD_REST).alias("held_out"),
        score_column(F.col("text"), learn(docs, labels, sample)).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
