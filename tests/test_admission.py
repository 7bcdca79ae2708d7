"""Set-based admission against a row-by-row walk in plain Python."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest

from pyspark.sql import functions as F

from seatwise.operators import admission
from seatwise.operators.admission import admit_slots, earlier_sum, restaurant_seats
from tests.seed import at, frame
from tests.test_intervals import T0


def walk(candidates, stored, bookings, seats, total=None):
    """Insert one candidate after the other; returns slot id -> rule."""
    slots, answer = list(stored), {}
    end = lambda s: s[3] + timedelta(seconds=s[4])
    for c in sorted(candidates, key=lambda c: (c[5], c[0])):
        booking = bookings.get(c[2])
        crossing = any(
            s[1] == c[1] and bookings[s[2]][2] != 4 and s[3] < end(c) and c[3] < end(s) and c[4] > 0
            for s in slots)
        if booking is None:
            rule = "booking_missing"
        elif c[1] not in seats:
            rule = "table_missing"
        elif booking[1] > seats[c[1]]:
            rule = "party_too_big"
        elif crossing:
            rule = "table_overlap"
        elif any(s[2] == c[2] for s in slots):
            rule = "booking_has_slot"
        elif total is not None and booking[1] + sum(
            bookings[s[2]][1] for s in slots
            if bookings[s[2]][2] in (1, 2) and s[3] < end(c) and c[3] < end(s) and c[4] > 0
        ) > total:
            rule = "over_capacity"
        elif not 0 < c[4] <= 7200:
            rule = "slot_invalid"
        else:
            rule = None
            slots.append(c)
        answer[c[0]] = rule
    return answer


def batches(seed: int, groups: int, size: int, repeats: bool):
    """Independent random batches side by side: tables and bookings of a group are its own."""
    rng = random.Random(seed)
    bookings, seats, stored, candidates, slot = {}, {}, [], [], 0
    for g in range(groups):
        tables = [3 * g, 3 * g + 1]
        seats.update({t: rng.choice([4, 8]) for t in tables})
        own = list(range(1000 * g, 1000 * g + size))
        for b in own:
            bookings[b] = (1, rng.choice([2, 2, 4, 6]), rng.choice([1, 1, 2, 3, 4]))
        fresh = iter(rng.sample(own, size))
        for i in range(size):
            slot += 1
            booking = rng.choice(own[: size // 2]) if repeats else next(fresh)
            booking = 1000 * g + 999 if rng.random() < 0.05 else booking
            start = T0 + timedelta(minutes=30 * rng.randrange(16))
            row = (slot, rng.choice([*tables, tables[1] + 1]) if rng.random() < 0.1 else rng.choice(tables),
                   booking, start, rng.choice([1800, 3600, 7200]))
            if rng.random() < 0.1:
                row = (*row[:4], rng.choice([0, 10800]))
            is_stored = i < 2 and 0 < row[4] <= 7200 and row[2] in bookings and row[1] in tables
            (stored if is_stored else candidates).append(row if is_stored else (*row, rng.randrange(1000)))
    return bookings, seats, stored, candidates


@pytest.mark.parametrize("repeats,block_size", [(False, 1000), (True, 1000), (False, 2), (True, 3)])
def test_equals_row_by_row(spark, repeats, block_size):
    bookings, seats, stored, candidates = batches(11 + block_size, 40, 12, repeats)
    # in the trigger an over-full stored slot stays; only its overlap and booking count
    schema = "slot_id long, table_id long, booking_id long, start timestamp_ntz, duration_s long, arrived long"
    got = admit_slots(
        spark.createDataFrame(candidates, schema), frame(spark, "slots", stored),
        frame(spark, "bookings", [(b, *v) for b, v in bookings.items()]),
        frame(spark, "dining_tables", list(seats.items())), ["arrived"], block_size,
    ).collect()
    assert {r["slot_id"]: r["rule"] for r in got} == walk(candidates, stored, bookings, seats)
    assert len(got) == len(candidates)


def test_one_table_holds_everything(spark):
    """One island far longer than the block, in time order: decided over several rounds."""
    n = 120
    bookings = {i: (1, 2, 1) for i in range(n)}
    candidates = [(i, 1, i, T0 + timedelta(minutes=5 * i), 1800, i) for i in range(n)]
    schema = "slot_id long, table_id long, booking_id long, start timestamp_ntz, duration_s long, arrived long"
    got = admit_slots(
        spark.createDataFrame(candidates, schema), frame(spark, "slots", []),
        frame(spark, "bookings", [(b, *v) for b, v in bookings.items()]),
        frame(spark, "dining_tables", [(1, 4)]), ["arrived"], block_size=40,
    ).collect()
    assert {r["slot_id"]: r["rule"] for r in got} == walk(candidates, [], bookings, {1: 4})


SCHEMA = "slot_id long, table_id long, booking_id long, start timestamp_ntz, duration_s long, arrived long"


def admitted(spark, candidates, stored, bookings, seats, **more):
    got = admit_slots(
        spark.createDataFrame(candidates, SCHEMA), frame(spark, "slots", stored),
        frame(spark, "bookings", [(b, *v) for b, v in bookings.items()]),
        frame(spark, "dining_tables", list(seats.items())), ["arrived"], **more,
    ).collect()
    assert len(got) == len(candidates)
    return {r["slot_id"]: r["rule"] for r in got}


@pytest.mark.parametrize("seed,repeats,total,block_size", [
    (1, False, 30, 1000), (2, True, 25, 5), (5, True, 0, 1000), (6, False, 10_000, 1000),
])
def test_capacity_is_part_of_the_sequence(spark, seed, repeats, total, block_size):
    bookings, seats, stored, candidates = batches(seed, 20, 12, repeats)
    want = walk(candidates, stored, bookings, seats, total)
    assert total > 9_000 or sum(r == "over_capacity" for r in want.values()) > 8
    assert total < 25 or sum(r is None for r in want.values()) > 20
    rounds = []
    got = admitted(spark, candidates, stored, bookings, seats, total=F.lit(total), rounds=rounds, block_size=block_size)
    assert got == want and len(rounds) < 25


def test_capacity_of_the_seats_of_all_tables(spark):
    """Two tables, six seats: the third party at one time does not fit; a released one is not counted but has to fit."""
    bookings = {i: (1, p, s) for i, (p, s) in enumerate([(2, 1), (4, 3), (3, 1), (2, 1), (1, 2)])}
    candidates = [(10 + i, [1, 2, 3, 3, 4][i], i, T0, 3600, i) for i in range(5)]
    seats = {1: 2, 2: 4, 3: 3, 4: 2}
    rows = lambda total: admitted(spark, candidates, [], bookings, seats, total=total)
    assert rows(F.lit(6)) == walk(candidates, [], bookings, seats, 6) == {
        10: None, 11: None, 12: None, 13: "table_overlap", 14: None}
    tables = frame(spark, "dining_tables", list(seats.items()))
    assert rows(restaurant_seats(tables)) == walk(candidates, [], bookings, seats, 11)
    assert admitted(spark, [], [], bookings, seats, total=restaurant_seats(tables)) == {}


def test_no_sum_in_order_of_arrival_where_all_fit(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(admission, "earlier_sum", lambda w, *a: asked.append(w.count()) or earlier_sum(w, *a))
    bookings = {i: (1, 2, 1) for i in range(5)}
    candidates = [(10 + i, [1, 2, 3, 3, 4][i], i, T0, 3600, i) for i in range(5)]
    rows = lambda total: admitted(spark, candidates, [], bookings, {t: 2 for t in range(1, 5)}, total=F.lit(total))
    assert rows(12) == walk(candidates, [], bookings, {t: 2 for t in range(1, 5)}, 12) and asked == []
    assert rows(5) == walk(candidates, [], bookings, {t: 2 for t in range(1, 5)}, 5) and asked


def chain(n, backward=False):
    rng = random.Random(n)
    bookings = {i: (1, 2, rng.choice([1, 1, 1, 3, 4])) for i in range(n)}
    rows = [(i, 1, i, T0 + timedelta(minutes=rng.choice([4, 5, 5]) * i // 5 * 5), rng.choice([1200, 1800, 3600])) for i in range(n)]
    if backward:
        rows.sort(key=lambda r: r[3] + timedelta(seconds=r[4]), reverse=True)
        rows = [(i, 1, i, *r[3:]) for i, r in enumerate(rows)]
    else:
        rows.sort(key=lambda r: r[3])
        rows = [(i, 1, i, *r[3:]) for i, r in enumerate(rows)]
    return bookings, [(*r, i) for i, r in enumerate(rows)]


@pytest.mark.parametrize("backward", [False, True])
def test_a_long_chain_in_order_takes_logarithmic_rounds(spark, backward):
    """One table, one island of 3,000 slots with blocks of 50: not 60 rounds but a few, whatever the block size."""
    bookings, candidates = chain(3000, backward)
    want = walk_one_table(candidates, bookings)
    rounds = []
    got = admitted(spark, candidates, [], bookings, {1: 4}, block_size=50, rounds=rounds)
    assert got == want
    assert len(rounds) + sum(rounds) <= 16 and max(rounds) >= 8


def walk_one_table(candidates, bookings):
    """The walk, for slots that can only overlap admitted ones of the last two hours or the next two."""
    import bisect

    taken, answer = [], {}
    for c in candidates:
        end = c[3] + timedelta(seconds=c[4])
        at = bisect.bisect_left(taken, (c[3] - timedelta(hours=2), c[3]))
        near = taken[at : bisect.bisect_left(taken, (end, end))]
        crossing = any(s < end and c[3] < e for s, e in near)
        answer[c[0]] = "table_overlap" if crossing else None
        if not crossing and bookings[c[2]][2] != 4:
            bisect.insort(taken, (c[3], end))
    return answer


def test_twenty_thousand_slots_in_time_order(spark):
    n = 20_000
    candidates = [(i, 1, i, T0 + timedelta(minutes=5 * i), 1800, i) for i in range(n)]
    rounds = []
    got = admitted(spark, candidates, [], {i: (1, 2, 1) for i in range(n)}, {1: 4}, rounds=rounds)
    assert got == {i: None if i % 6 == 0 else "table_overlap" for i in range(n)}
    assert len(rounds) + sum(rounds) <= 20


def test_sums_of_those_before(spark):
    rng = random.Random(3)
    rows = [(i, s, s + rng.randrange(1, 60) * 1_000_000, rng.randrange(4)) for i, s in enumerate(
        rng.randrange(3_000) * 1_000_000 for _ in range(300))]
    table = spark.createDataFrame(rows, "_no long, _s long, _e long, _people long")
    got = {r["_no"]: r["p"] for r in earlier_sum(table, table.filter("_no % 3 > 0"), "p", 300).collect()}
    assert got == {
        i: sum(p for j, a, z, p in rows if j < i and j % 3 and a < e and s < z) for i, s, e, _ in rows}


def test_seed_batch(spark, seed):
    """Two slots for one booking, and a cancelled one that uses its booking but no table."""
    new = spark.createDataFrame([
        (20, 12, 10, at("18:00"), 7200, 1),    # booking 10 is cancelled
        (21, 12, 7, at("18:30"), 7200, 2),     # booking 7 already has a slot
        (22, 13, 10, at("18:00"), 7200, 3),    # second slot of booking 10
    ], "slot_id long, table_id long, booking_id long, start timestamp_ntz, duration_s long, arrived long")
    got = admit_slots(new, seed["slots"], seed["bookings"], seed["dining_tables"], ["arrived"])
    assert {r["slot_id"]: r["rule"] for r in got.collect()} == {
        20: None, 21: "booking_has_slot", 22: "booking_has_slot"}
