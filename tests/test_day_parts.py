"""Daily figures that follow changes, against computing them anew."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seatwise.sources import day_parts
from seatwise.sources.day_parts import daily_figures, merge_day_parts, read_day_parts, write_day_parts

LINE = "line_id long, dish_id long, status int, qty long, requested timestamp_ntz"


def figures(spark, seed, lines, home=None):
    parts = read_day_parts(spark, home) if home else day_parts.day_parts(lines)
    return sorted(map(tuple, daily_figures(parts, seed["dishes"]).collect()), key=str)


def random_line(rng, i):
    day = datetime(2026, 1 + rng.randrange(4), 1 + rng.randrange(3), rng.randrange(24))
    return i, rng.choice([1, 1, 1, 2, 3, 99]), rng.randrange(1, 4), rng.randrange(1, 9), rng.choice([day] * 9 + [None])


def files(home):
    return {m.name: sorted((f.name, f.stat().st_mtime_ns) for f in m.glob("part-*")) for m in Path(home, "parts").glob("day_month=*")}


def test_batches_of_changes_equal_full_sums(spark, seed, tmp_path):
    rng, home = random.Random(3), str(tmp_path / "parts")
    lines = {i: random_line(rng, i) for i in range(200)}
    frame = lambda rows: spark.createDataFrame(list(rows), LINE)
    write_day_parts(frame(lines.values()), home)
    for batch in range(3):
        before, after = [], []
        for i in rng.sample(sorted(lines), 30):
            before.append(lines.pop(i))
            if rng.random() < 0.6:
                after.append(random_line(rng, i))
        after += [random_line(rng, 1000 * (batch + 1) + i) for i in range(10)]
        lines |= {row[0]: row for row in after}
        assert merge_day_parts(spark, home, frame(before), frame(after), f"b{batch}")
        assert figures(spark, seed, None, home) == figures(spark, seed, frame(lines.values()))
    assert not merge_day_parts(spark, home, frame([]), frame(lines.values()), "b1")
    assert figures(spark, seed, None, home) == figures(spark, seed, frame(lines.values()))


def test_only_touched_months_and_a_star_that_falls(spark, seed, tmp_path):
    home, day = str(tmp_path / "parts"), datetime(2026, 4, 5, 12)
    frame = lambda rows: spark.createDataFrame(rows, LINE)
    rows = [(i, 1 if i < 3 else 2, 3, 1, day) for i in range(5)] + [(9, 3, 3, 1, day - timedelta(days=40))]
    write_day_parts(frame(rows), home)
    star = lambda: {str(r.day): r.star_dish for r in daily_figures(read_day_parts(spark, home), seed["dishes"]).collect()}
    assert star()["2026-04-05"] == "Dish 01"
    was = files(home)
    merge_day_parts(spark, home, frame(rows[:2]), frame([]), "gone")
    assert star()["2026-04-05"] == "Dish 02"
    now = files(home)
    assert {m for m in now if now[m] != was[m]} == {"day_month=2026-04"}
    merge_day_parts(spark, home, frame(rows[2:5]), frame([]), "all gone")
    assert set(star()) == {"2026-02-24"}
    merge_day_parts(spark, home, frame([]), frame([]), "nothing")
    merge_day_parts(spark, home, frame([]), frame([(7, 2, 1, 1, datetime(2030, 1, 1))]), "a new month")
    assert set(star()) == {"2026-02-24", "2030-01-01"}


def test_a_batch_that_breaks_off_is_completed(spark, seed, tmp_path, monkeypatch):
    home, day = str(tmp_path / "parts"), datetime(2026, 4, 5, 12)
    frame = lambda rows: spark.createDataFrame(rows, LINE)
    rows = [(i, 1, 3, 1, day + timedelta(days=40 * i)) for i in range(3)]
    write_day_parts(frame(rows), home)
    more = frame([(9, 2, 3, 5, day), (10, 2, 3, 5, day + timedelta(days=40))])
    right = day_parts._write

    def breaks(parts, path, mode="static"):
        right(parts.filter(F.col("day_month") == "2026-04"), path, mode)
        raise RuntimeError("lost")

    monkeypatch.setattr(day_parts, "_write", breaks)
    with pytest.raises(RuntimeError):
        merge_day_parts(spark, home, frame([]), more, "b")
    monkeypatch.setattr(day_parts, "_write", right)
    assert merge_day_parts(spark, home, frame([]), more, "b") and not merge_day_parts(spark, home, frame([]), more, "b")
    assert figures(spark, seed, None, home) == figures(spark, seed, frame(rows).unionByName(more))
