import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seatwise.llm import common, lm
from tests.llm.odd import DOCS, docs, words


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def check_counts(rows, got):
    seen = Counter()
    for d, t, *_ in rows:
        if not held(d):
            seen.update([*words(t), "\n"])
    n, v = sum(seen.values()), len(seen)
    want = []
    for d, t, *_ in rows:
        w = [*words(t), "\n"]
        want.append((str(d), held(d), len(w), sum(seen[x] > 0 for x in w), n, round(sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w), 5)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)


def test_rows_in_any_state(spark):
    got = lm.score(docs(spark)).collect()
    check_counts(DOCS, got)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert lm.score(docs(spark, [])).count() == 0


def test_words_beyond_the_broadcast_ones(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(1, 40)), "en", "a") for i in range(60)]
    whole = {r.doc_id: r for r in lm.score(docs(spark, rows)).collect()}
    table = lm.ids_and_text(docs(spark, rows)).withColumn("held_out", lm.fold_out("doc_id", 7, 2))
    counts = lm.word_counts(table)
    few = lm.vocabulary(counts, top=20).value
    assert 0 < sum(w != b" " for w in few.known) <= 21 and few.n == lm.vocabulary(counts).value.n
    rare = {k: Counter() for k in range(lm.RARE)}
    for d, t, *_ in rows:
        for w in [] if held(d) else words(t):
            if w.encode() not in few.known:
                rare[lm.rare_class(w.encode())][w] += 1
    assert np.allclose(few.rare_log, [np.log10(sum(c.values()) + len(c) + 1) for c in rare.values()])
    check_counts(rows, whole.values())
    real = lm.vocabulary
    monkeypatch.setattr(lm, "vocabulary", lambda c: real(c, top=20))
    check_counts(rows, lm.score(docs(spark, rows)).collect())


def test_nothing_to_learn_from(spark):
    rows = [(d, "a b", "en", "a") for d in range(200) if held(d)]
    got = lm.score(docs(spark, rows)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got) and len(got) == len(rows)


def network(seed=3):
    rng = np.random.default_rng(seed)
    return lm.Network(rng.normal(0, 0.3, lm.Network().flat.size))


def test_classes_and_words_are_a_distribution():
    net = network()
    states = np.random.default_rng(1).normal(size=(1, lm.STATE))
    cls = np.arange(lm._CLASSES)
    p = np.exp(-net.nll(np.repeat(states, len(cls), 0), cls, np.full(len(cls), -1)))
    assert p.sum() == pytest.approx(1)
    word = np.arange(lm._MODEL_WORDS)
    q = np.exp(-net.nll(np.repeat(states, len(word), 0), word // lm.CLASS_SIZE, word))
    assert q.sum() == pytest.approx(p[: lm.WORD_CLASSES].sum())


def test_gradient_equals_differences():
    net = network()
    rng = np.random.default_rng(2)
    x = rng.integers(0, lm._BEGIN, (5, 3))
    word = np.where(rng.random((5, 3)) < 0.6, rng.integers(0, lm._MODEL_WORDS, (5, 3)), -1)
    cls = np.where(word >= 0, word // lm.CLASS_SIZE, lm.WORD_CLASSES + 1)
    valid = rng.random((5, 3)) < 0.9
    lm_run = net.run
    net.run = lambda g, h, keep=None: lm_run(g, h, keep).astype(np.float64)
    h = np.zeros((3, lm.STATE))
    _, _, slope = net.gradient(x, cls, word, valid, h)
    at = 0
    for shape in net.SHAPES.values():
        size = int(np.prod(shape))
        part = slope[at : at + size]
        for i in at + np.argsort(-np.abs(part))[:3]:
            old, d = net.flat[i], 1e-2
            net.flat[i] = old + d
            up = net.gradient(x, cls, word, valid, h)[0]
            net.flat[i] = old - d
            down = net.gradient(x, cls, word, valid, h)[0]
            net.flat[i] = old
            assert slope[i] == pytest.approx((up - down) / (2 * d), rel=2e-2, abs=1e-6)
        at += size


def test_state_is_carried_over_windows():
    """A document's score does not depend on the windows or on what runs beside it."""
    rng = np.random.default_rng(4)
    items = []
    for i in range(9):
        n = int(rng.integers(1, 90))
        word = rng.integers(0, lm._MODEL_WORDS, n)
        items.append((i, np.r_[lm._BEGIN, word[:-1]], word // lm.CLASS_SIZE, word))
    net, sums = network(), []
    for streams, length in ((1, 1000), (4, 7), (20, 32)):
        total, state, ended = np.zeros(9), np.zeros((streams, lm.STATE), np.float32), []
        for slots, fresh, x, cls, word, valid in lm._windows(iter(items), streams, length):
            state[fresh] = 0
            at = [s for s, _, _ in slots]
            states = net.run(net.entered(x), state[at])
            state[at] = states[-1]
            loss = np.zeros(valid.shape)
            loss[valid] = net.nll(states[valid], cls[valid], word[valid])
            for (_, item, over), nats in zip(slots, loss.sum(0)):
                total[item] += nats
                ended += [item] * over
        assert sorted(ended) == list(range(9))
        sums.append(total)
    assert np.allclose(sums[0], sums[1], rtol=1e-4) and np.allclose(sums[0], sums[2], rtol=1e-4)


def test_beats_word_counts_on_held_out_documents(spark):
    got = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum() and (got.score > got.base_score).mean() > 0.7


def test_the_network_sees_every_learning_document(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(1, 5 + i % 40)), "en", "a") for i in range(200)]
    seen, real = [], lm._together
    monkeypatch.setattr(lm, "_together", lambda p: seen.append(p.filter("piece = 0").agg({"tokens": "sum"}).first()[0]) or real(p))
    lm.score(docs(spark, rows)).collect()
    assert seen[-1] == sum(len(words(t)) + 1 for d, t, *_ in rows if not held(d))


def test_training_stays_in_single_precision():
    """Steps in double precision cost twice the memory traffic and gain nothing."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, lm._BEGIN, (5, 3))
    word = rng.integers(0, lm._MODEL_WORDS, (5, 3))
    state = np.zeros((3, lm.STATE), np.float32)
    _, after, slope = lm.Network().gradient(x, word // lm.CLASS_SIZE, word, np.ones((5, 3), bool), state)
    assert slope.dtype == after.dtype == np.float32


def test_rows_worked_on_at_a_time_change_nothing(monkeypatch):
    net, rng = network(), np.random.default_rng(6)
    word = np.where(rng.random(300) < 0.7, rng.integers(0, lm._MODEL_WORDS, 300), -1)
    cls = np.where(word >= 0, word // lm.CLASS_SIZE, lm.WORD_CLASSES + 1)
    found = []
    for rows in (1, 40, 1000):
        monkeypatch.setattr(lm, "_ROWS", rows)
        slopes = {}
        loss, back = net.nll(np.tanh(np.random.default_rng(7).normal(size=(300, lm.STATE))), cls, word, slopes)
        found.append(np.concatenate([loss, back.ravel(), *[v.ravel() for v in slopes.values()]]))
    assert np.allclose(found[0], found[2]) and np.allclose(found[1], found[2])


def test_a_window_takes_little_new_memory():
    """The largest arrays of a window are used again by the next one: 7.5 MB at most are new, 8.1 before."""
    rng = np.random.default_rng(9)
    word = rng.integers(0, lm._MODEL_WORDS, (20, 256))
    args = rng.integers(0, lm._BEGIN, (20, 256)), word // lm.CLASS_SIZE, word, np.ones((20, 256), bool), np.zeros((256, lm.STATE), np.float32)
    network = lm.Network()
    network.gradient(*args)
    tracemalloc.start()
    network.gradient(*args)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 7_800_000


def test_tokens_are_the_words_and_an_end():
    odd = [b"", b" \t ", b"A b  a\x0bB", b"\xff\xfe A\x00B\x1c c\x85d\xa0E \x0c", "ÄÖ ä b c".encode(), b"x" * 300, b"A a A"]
    texts = pa.array([b"before", *odd], pa.binary()).slice(1)
    codes, distinct, starts = lm._tokens(texts)
    tokens = [distinct[int(c)].as_py() for c in codes]
    bounds = [*starts.tolist(), len(tokens)]
    assert [tokens[a:b] for a, b in zip(bounds, bounds[1:])] == [[*common.words(t), lm.END] for t in odd]
    assert len(set(distinct.to_pylist())) == len(distinct)
    assert [len(part) for part in lm._tokens(texts.slice(0, 0))] == [0, 1, 0]


def test_longest_texts_of_a_batch_come_first(monkeypatch):
    """In all blocks together: a long text that begins in the last block is read on alone."""
    monkeypatch.setattr(lm, "BLOCK", 40)
    texts = [b"x" * n for n in (3, 50, 0, 12, 30, 12, 60, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([False] * 8), pa.array(texts)], ["doc_id", "held_out", "text"])
    blocks = list(lm._blocks(batch))
    assert [i for ids, _, _ in blocks for i in ids] == [6, 1, 4, 3, 5, 0, 7, 2] and len(blocks) > 2
    assert all(t.to_pylist() == [texts[i] for i in ids] for ids, _, t in blocks)
