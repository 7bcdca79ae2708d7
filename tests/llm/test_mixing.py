from collections import Counter

import pytest

from seatwise.llm import mixing
from tests.llm.odd import DOCS, docs, words


def targets_of(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return {**out, **{s: left * weight[s] / total for s in free}}
        for s in over:
            out[s] = float(most * sizes[s])
            free.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def check(rows, got):
    size = {s: sum(len(words(t)) for _, t, _, o in rows if o == s) for s in {r[3] for r in rows}}
    want = targets_of(size)
    taken = Counter()
    source = {d: s for d, _, _, s in rows}
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, len(words(t))) for d, t, _, _ in rows)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_takes_the_targets(spark, block):
    rows = DOCS + [(1000 + i, "w " * (i % 37), "en", "abcdefg"[i % 7]) for i in range(200)]
    got = mixing.mix(docs(spark, rows), block=block).collect()
    check(rows, got)
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    again = mixing.mix(docs(spark, rows).repartition(3), block=block).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_slots_follow_the_weights_at_every_length(spark):
    rows = [(i, "w " * 50, "en", "abc"[i % 3]) for i in range(300)]
    plan = mixing.targets(mixing.sized(docs(spark, rows)))
    slots = [r.s for r in mixing.schedule(plan, 10).orderBy("late", "slot").collect()]
    want = {r.s: r.target for r in plan.collect()}
    for upto in (50, 200, 700, len(slots)):
        for s, target in want.items():
            assert abs(slots[:upto].count(s) - upto * target / sum(want.values())) <= 12


def test_each_block_is_taken_once(spark):
    rows = [(i, "w " * (i % 90), "en", "ab"[i % 2]) for i in range(100)]
    plan = mixing.targets(mixing.sized(docs(spark, rows)))
    blocks = [(r.s, r.block) for r in mixing.schedule(plan, 16).collect()]
    want = {(r.s, b) for r in plan.collect() for b in range(-(-round(r.target) // 16))}
    assert len(blocks) == len(set(blocks)) and set(blocks) == want


def test_nothing_to_mix(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [(1, None, None, None), (2, "", None, "a")])).collect()] == [0, 0]


def test_the_point_sequence_decides_the_slots(spark, monkeypatch):
    """Other points, other slots: each document's first slot is where the schedule puts its first block."""
    rows = [(i, "w " * (20 + i % 9), "en", "abc"[i % 3]) for i in range(300)]

    def first_slots():
        return {r.doc_id: r.first_slot for r in mixing.mix(docs(spark, rows), block=16).collect()}

    golden = first_slots()
    by_doc = {}
    stream = mixing.mixed_stream(docs(spark, rows), block=16).collect()
    for r in stream:
        by_doc[r.doc_id] = min(by_doc.get(r.doc_id, r.slot), r.slot)
    assert by_doc == {d: s for d, s in golden.items() if s is not None}
    monkeypatch.setattr(mixing, "GOLDEN", 0.001)
    assert first_slots() != golden


def test_the_stream_holds_the_words_that_are_taken(spark):
    rows = DOCS + [(1000 + i, "w " * (i % 37), "en", "abcdefg"[i % 7]) for i in range(200)]
    taken = Counter()
    for r in mixing.mixed_stream(docs(spark, rows), block=64).collect():
        assert 0 <= r["from"] < r.to
        taken[r.doc_id] += r.to - r["from"]
    want = Counter()
    for r in mixing.mix(docs(spark, rows), block=64).collect():
        want[r.doc_id] += r.taken
    assert +taken == +want
