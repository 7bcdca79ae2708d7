import numpy as np
import pytest
from pyspark.sql import functions as F

from seatwise.llm import quality
from tests.llm.odd import DOCS, docs


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(1)
    machine = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)))
    rows = [quality.features(t) for t in (b"", b"some words of a text, some words", b"A!! B!! C")]
    at, value = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
    got, _ = machine.margin(at, value, np.repeat(np.arange(3), [len(a) for a, _ in rows]), 3)
    for (a, v), g in zip(rows, got):
        pairs = sum(machine.factors[a[i]] @ machine.factors[a[j]] * v[i] * v[j] for i in range(len(a)) for j in range(i))
        assert g == pytest.approx(0.3 + machine.single[a] @ v + pairs)


def test_pairs_are_learnt():
    """The label is whether two words come together; neither tells anything alone."""
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for _ in range(600):
        a, b = rng.integers(0, 2, 2)
        texts.append(" ".join(["left" if a else "right", "up" if b else "down"]).encode())
        labels.append(int(a == b))
    machine = quality.fit([quality.features(t) for t in texts], np.array(labels), np.ones(600), epochs=40)
    assert ((machine.scores(texts) > 0.5) == np.array(labels)).mean() > 0.95


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    got = quality.quality(read("documents"), read("labels")).join(read("labels"), "doc_id").filter("held_out")
    right, n = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right >= 0.93


def test_rows_in_any_state(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 1, 0), (4, 0, 0), (None, 1, 0), (7, None, 0), (6, 0, None)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs(spark), labels).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert {r.score for r in quality.quality(docs(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs(spark, []), labels).count() == 0
