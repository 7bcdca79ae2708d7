"""The kitchen queue in packs of lines: odd lines, repeated rows, and cooks with more lines than a range holds."""

from __future__ import annotations

import re
from datetime import datetime

import pytest

from seatwise.functions.columns import REQUESTED
from seatwise.operators.joins import ordered
from seatwise.plans import service

DAY, NOON = datetime(1995, 3, 5), datetime(1995, 3, 5, 12, 30)
ODD = [
    (1, 7, 1, 3, DAY), (1, 7, 1, 3, DAY), (2, 7, 2, 255, DAY), (3, 7, 1, 256, DAY), (4, 7, 1, None, DAY), (5, 7, 1, 0, None),
    (-6, 7, 1, 1, DAY), (1 << 40, 7, 1, 1, DAY), ((1 << 31) - 1, 7, 255, 1, DAY), (7, 7, 300, 1, DAY), (8, 7, 1, 1, NOON),
    (9, 7, 1, 1, datetime(1901, 1, 1)), (None, 7, 1, 1, DAY), (10, 7, None, 1, DAY), (11, None, 1, 1, DAY), (12, 99, 1, 1, DAY),
    (13, 7, 1, -1, DAY), (14, 7, 1, 1, datetime(2160, 1, 1)),
]
MANY = [(100 + i, 7 + i % 3, i % 5, i, datetime(1995, 1 + i % 12, 1 + i % 28)) for i in range(60)]


@pytest.fixture
def kitchen(spark):
    rows = [(*r, REQUESTED) for r in ODD + MANY] + [(500, 7, 1, 1, DAY, REQUESTED + 1)]
    lines = spark.createDataFrame(rows, "order_id long, dish_id long, line_no int, qty long, requested timestamp_ntz, status int")
    dishes = spark.createDataFrame([(7, "soup", 600), (8, "rice", 600), (9, None, None), (10, "none", 60)], "dish_id long, name string, prep_s long")
    pairs = [(1, 7), (1, 8), (1, 9), (2, 7), (2, 7), (3, 9), (None, 8), (4, 10), (4, None), (5, 98)]
    return lines, dishes, spark.createDataFrame(pairs, "cook_id long, dish_id long")


@pytest.mark.parametrize("pack,group", [(256, 1 << 17), (4, 1 << 17), (256, 30), (4, 0), (1, 25)])
def test_packs_give_the_lines_in_order(kitchen, monkeypatch, pack, group):
    monkeypatch.setattr(service, "PACK", pack)
    monkeypatch.setattr(service, "GROUP", group)
    lines, dishes, pairs = kitchen
    plain = lines.filter(f"status = {REQUESTED}").join(dishes.withColumnRenamed("name", "dish"), "dish_id").join(pairs, "dish_id")
    plain = plain.select("cook_id", "order_id", "line_no", "dish", "prep_s", "qty", "requested")
    keys = ["cook_id", "-prep_s", "requested", "order_id", "line_no"]
    found = service.kitchen_queue(lines, dishes, pairs)
    assert found.dtypes == plain.dtypes
    total = lambda rows: sorted(map(repr, map(tuple, rows)))
    got, wanted = found.collect(), ordered(plain, *keys).collect()
    assert len(got) > 150 and total(got) == total(wanted)
    place = lambda rows: [(r.cook_id, r.prep_s, r.requested, r.order_id, r.line_no) for r in rows]
    assert place(got) == place(wanted)


def test_lines_are_taken_out_after_the_shuffle(kitchen):
    """A dish's lines go to a cook in one row, not in one for each line."""
    plan = service.kitchen_queue(*kitchen)._jdf.queryExecution().optimizedPlan().toString()
    above, below = re.split(r"RepartitionByExpression", plan, maxsplit=1)
    assert "inline" in above and "collect_list" in below
