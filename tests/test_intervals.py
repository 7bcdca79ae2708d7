"""Interval operators against brute force on random rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seatwise.functions.columns import epoch_us
from seatwise.operators.intervals import (
    active_at_each, dyadic_cells, islands, overlap_join, overlap_sum, overlaps_any, starting_within, with_bounds,
)
from seatwise.operators.running import running

T0 = datetime(2024, 3, 1, 12)


def intervals(seed: int, n: int, keys: int, hot: float = 0.4):
    """Random intervals with a hot key, many equal bounds, touching, nested and empty ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rng.random() < hot else rng.randrange(keys)
        start = T0 + timedelta(minutes=15 * rng.randrange(60), microseconds=rng.choice([0, 0, 0, 1]))
        length = rng.choice([0, 900, 1800, 3600, 7200])
        rows.append((i, key, start, length, rng.randrange(1, 9)))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, key long, start timestamp_ntz, duration_s long, amount int")
    return with_bounds(df)


def bounds(row):
    return row[2], row[2] + timedelta(seconds=row[3])


def meet(x, y):
    (a, b), (c, d) = bounds(x), bounds(y)
    return a < d and c < b and a < b and c < d


@pytest.mark.parametrize("keyed", [True, False])
def test_overlap_sum_equals_brute_force(spark, keyed):
    stored, asked = intervals(1, 300, 5), intervals(2, 200, 7)
    got = overlap_sum(
        frame(spark, asked), frame(spark, stored), "amount", "total", ["key"] if keyed else [])
    assert got.columns[-1] == "total" and len(got.columns) == 8
    keys = ["key"] if keyed else []
    met = overlaps_any(frame(spark, asked), frame(spark, stored), "met", keys).collect()
    assert {r["id"]: r["met"] for r in met} == {
        x[0]: any(meet(x, y) and (not keyed or x[1] == y[1]) for y in stored) for x in asked
    }
    want = {
        x[0]: sum(y[4] for y in stored if meet(x, y) and (not keyed or x[1] == y[1])) for x in asked
    }
    assert {r["id"]: r["total"] for r in got.collect()} == want


def test_overlap_sum_with_null_bounds_and_keys(spark):
    stored = frame(spark, [(1, 1, T0, 3600, 5), (2, None, T0, 3600, 7), (3, 1, None, 3600, 9)])
    asked = frame(spark, [(1, 1, T0, 60, 0), (2, None, T0, 60, 0), (3, 1, None, 60, 0), (4, 2, T0, 60, 0)])
    got = overlap_sum(asked, stored, "amount", "total", ["key"])
    assert sorted((r["id"], r["total"]) for r in got.collect()) == [(1, 5), (2, 0), (3, 0), (4, 0)]


def long_intervals(seed: int, n: int):
    """Random intervals from none to eighty years, around and before 1970, many with equal bounds."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.choice([T0, datetime(1969, 12, 31, 23), datetime(1, 1, 1), datetime(2024, 1, 1)])
        start += timedelta(seconds=rng.choice([0, 1, 3600, 86400 * 30, 86400 * 3650]) * rng.randrange(3))
        length = rng.choice([0, 1, 7200, 86400, 86400 * 31, 86400 * 3652, 86400 * 29220])
        rows.append((i, rng.choice([0, 0, 1, None]), start, length, 1))
    return rows


@pytest.mark.parametrize("make", [lambda seed: intervals(seed, 150, 4), lambda seed: long_intervals(seed, 150)])
def test_overlap_join_equals_brute_force(spark, make):
    left, right = make(3), make(4)
    pairs = overlap_join(frame(spark, left), frame(spark, right), ["key"])
    got = sorted((r["id"], r["id_2"]) for r in pairs.collect())
    same = lambda x, y: x[1] is not None and x[1] == y[1]
    assert got and got == sorted((x[0], y[0]) for x in left for y in right if same(x, y) and meet(x, y))


def test_overlap_join_of_empty_sides(spark):
    some, none = frame(spark, intervals(3, 20, 2)), frame(spark, [])
    for a, b in [(some, none), (none, some), (none, none)]:
        assert overlap_join(a, b, ["key"]).collect() == []


def test_dyadic_cells_cover_a_range_once(spark):
    rng = random.Random(8)
    width = 1 << 33
    spans = [(rng.randrange(-(1 << 57), 1 << 57), rng.choice([1, width, 5 * width, 10 * 365 * 86_400_000_000, 1 << 56])) for _ in range(300)]
    rows = spark.createDataFrame([(low, low + n - 1) for low, n in spans], "low long, high long")
    for r in rows.select("low", "high", dyadic_cells(F.col("low"), F.col("high")).alias("cells")).collect():
        parts = sorted((c << 2 * level, (c + 1) << 2 * level) for level, c in r["cells"])
        assert parts[0][0] == r["low"] >> 33 and parts[-1][1] == (r["high"] >> 33) + 1
        assert all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
        assert len(parts) <= 80


def test_islands_are_chains(spark):
    rows = [r for r in intervals(5, 300, 6) if r[3] > 0]
    got = {r["id"]: (r["key"], r["_island"]) for r in islands(frame(spark, rows), ["key"]).collect()}
    parent = {r[0]: r[0] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in rows:
        for y in rows:
            if x[1] == y[1] and meet(x, y):
                parent[root(x[0])] = root(y[0])
    chains = {}
    for r in rows:
        chains.setdefault(root(r[0]), set()).add(got[r[0]])
    assert all(len(v) == 1 for v in chains.values())
    assert len({next(iter(v)) for v in chains.values()}) == len(chains)


def test_instants_are_closed_at_both_ends(spark):
    slots, ticks = intervals(6, 200, 3), [T0 + timedelta(minutes=15 * i) for i in range(0, 70, 3)]
    refs = spark.createDataFrame([(t,) for t in ticks], "at timestamp_ntz")
    rows = frame(spark, slots).drop("_s", "_e")
    got = sorted((r["at"], r["id"]) for r in active_at_each(rows, refs).collect())
    assert got == sorted((t, x[0]) for x in slots for t in ticks if bounds(x)[0] <= t <= bounds(x)[1])
    near = sorted((r["at"], r["id"]) for r in starting_within(rows, refs, 1800).collect())
    assert near == sorted(
        (t, x[0]) for x in slots for t in ticks if t <= x[2] <= t + timedelta(minutes=30))


def test_running_totals_of_one_crowded_second(spark):
    """A third of the rows on one key, in one second; another third at one instant."""
    rng, base = random.Random(7), 1_700_000_000_000_000
    rows = [(0, base + rng.randrange(1_000_000), 1) for _ in range(300)]
    rows += [(0, base, 1)] * 300
    rows += [(rng.randrange(5), base + rng.randrange(-10**12, 10**12), 1) for _ in range(300)]
    df = spark.createDataFrame(rows, "key long, t long, n long").withColumn("last", F.col("t"))
    got = running(df, "t", {"n": "sum", "last": "max"}, ["key"]).collect()
    assert len(got) == len({r[:2] for r in rows})
    for r in got:
        earlier = [x for x in rows if x[0] == r["key"] and x[1] < r["t"]]
        assert r["n_before"] == len(earlier)
        assert r["n"] == sum(x[0] == r["key"] and x[1] == r["t"] for x in rows)
        assert r["last_before"] == max((x[1] for x in earlier), default=None)


def test_order_before_1970(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'1969-12-31 23:59:59.5' a, TIMESTAMP_NTZ'1970-01-01 00:00:01' b")
    assert tuple(df.select(epoch_us("a"), epoch_us("b")).first()) == (-500000, 1000000)
