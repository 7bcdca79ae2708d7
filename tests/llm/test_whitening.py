import math
import random
from fractions import Fraction

import numpy as np
import pytest

from seatwise.llm import whitening
from seatwise.llm.queries import op12_whitening

SCHEMA = "vec_id long, vector array<float>, n int, component int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 7, 7) for i, v in vectors], SCHEMA)


def brute(vectors, components=8):
    """Rows by plain exact arithmetic, one fit for each length."""
    out = {}
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in vectors if v is not None and all(
        c is not None and math.isfinite(c) for c in v)]
    for size in {len(v) for _, v in good if v}:
        own = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in good if len(v) == size]
        n, sums = len(own), [sum(x[k] for _, x in own) for k in range(size)]
        y = [[n * a - s for a, s in zip(x, sums)] for _, x in own]
        v = np.array([[float(Fraction(sum(r[a] * r[b] for r in y), n**3)) for b in range(size)] for a in range(size)])
        values, vectors_ = np.linalg.eigh(v)
        for (i, _), r in zip(own, y):
            for k in range(min(components, size)):
                e, w = values[-1 - k], vectors_[:, -1 - k]
                live = e > np.trace(v) * 1e-12
                out.setdefault((i, k + 1), []).append((
                    n, sum(a * a for a in r), abs(float(np.dot(r, w)) / n / math.sqrt(e)) if live else 0.0, e / np.trace(v) if live else 0.0))
    return out


def check(rows, want, near=1e-9):
    got = {}
    for r in rows:
        got.setdefault((r.vec_id, r.component), []).append((r.n, int(r.deviation_digits), abs(r.whitened), r.explained))
        assert r.deviation == (int(r.deviation_digits) if int(r.deviation_digits) < 2**63 else None)
        assert 0 <= r.identity_error <= 1e-4
    assert got.keys() == want.keys()
    for key, found in got.items():
        for a, b in zip(sorted(found), sorted(want[key]), strict=True):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=near), key


def random_vectors(seed, n, size, scale=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, scale * (k + 1)) for k in range(size)]) for i in range(n)]


@pytest.mark.parametrize("scale", [0.01, 1.0, 1e6])
def test_equals_plain_exact_arithmetic(spark, scale):
    vectors = random_vectors(1, 200, 12, scale)
    check(whitening.whiten(table(spark, vectors).repartition(5)).collect(), brute(vectors))


def test_digits_beyond_a_long(spark):
    vectors = random_vectors(2, 100, 5, 1e12)
    rows = whitening.whiten(table(spark, vectors)).collect()
    check(rows, brute(vectors))
    assert all(r.deviation is None for r in rows)


def test_small_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 16)
    monkeypatch.setattr(whitening, "ROUND_CELLS", 20)
    vectors = random_vectors(3, 60, 3) + [(1000 + i, v) for i, v in random_vectors(4, 50, 9)]
    check(whitening.whiten(table(spark, vectors)).collect(), brute(vectors))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = random_vectors(5, 30, 3) + [
        (100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 2.0]), (104, [1.0, -inf, 2.0]),
        (105, [0.0, 0.0, 0.0]), (0, [1.0, 2.0, 3.0]), (0, [1.0, 2.0, 3.0]), (106, [5.0]), (107, [1.0, 1.0]), (107, [2.0, 2.0]),
    ]
    check(whitening.whiten(table(spark, vectors)).collect(), brute(vectors))


def test_too_large_entries_take_no_part(spark):
    vectors = random_vectors(6, 30, 3)
    rows = whitening.whiten(table(spark, [*vectors, (99, [1e30, 1.0, 1.0])])).collect()
    check(rows, brute(vectors))


def test_a_null_id_is_kept_and_no_variance_is_no_error(spark):
    rows = whitening.whiten(table(spark, [(None, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert sorted((str(r.vec_id), r.component) for r in rows) == [("1", 1), ("1", 2), ("None", 1), ("None", 2)]
    assert all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (2, 0, 0, 0, 0) for r in rows)


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [])]])
def test_nothing_to_whiten(spark, vectors):
    got = whitening.whiten(table(spark, vectors))
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(op12_whitening(spark, folder).collect(), brute(vectors), 1e-8)
