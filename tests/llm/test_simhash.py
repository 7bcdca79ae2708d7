import random

import numpy as np
import pytest
import xxhash

from seatwise.llm import simhash
from seatwise.llm.components import components
from tests.llm.odd import DOCS, docs, words


def print_of(text):
    w = words(text)
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, near):
    """Smallest node that each reaches, by plain search."""
    found = {}
    for start in sorted(nodes):
        if start not in found:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in found:
                    found[x] = start
                    todo += [y for y in nodes if y not in found and near(x, y)]
    return found


def some_docs():
    rng = random.Random(3)
    rows = list(DOCS)
    for i in range(60):
        text = [rng.choice("abcdefghij") * rng.randint(1, 4) + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 120))]
        for j in range(rng.randint(1, 4)):
            copy = list(text)
            if j:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((100 + 10 * i + j, " ".join(copy), "en", "a"))
    return rows


def test_groups_equal_brute_force(spark):
    rows = some_docs()
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {(d, print_of(t)) for d, t, _, _ in rows}
    assert {(r.doc_id, r.fp % 2**64) for r in got} == prints
    by_print = classes({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for d, p in prints:
        if d is not None:
            least[by_print[p]] = min(d, least.get(by_print[p], d))
    assert all(r.component_id == least.get(by_print[r.fp % 2**64]) for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_tree_finds_all_within_radius(n):
    rng = np.random.default_rng(n)
    few = rng.integers(0, 2**63, max(1, n // 10), dtype=np.uint64)
    values = np.unique(rng.choice(few, n) ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)))
    group = np.sort(rng.integers(0, 3, len(values)))
    forest = simhash.Forest(values, group)
    roots = np.array([forest.root[g] for g in group.tolist()], np.int64)
    got = {p for a, b in forest.near(values, roots, 4) for p in zip(a.tolist(), b.tolist())}
    want = {
        (i, j) for i in range(len(values)) for j in range(len(values))
        if group[i] == group[j] and (int(values[i]) ^ int(values[j])).bit_count() <= 4
    }
    assert got == want


def test_split_buckets_lose_no_link(spark, monkeypatch):
    rows = [(i, i ^ (i << 20)) for i in range(400)]
    prints = spark.createDataFrame(rows, "doc_id long, fp long").select("fp").distinct()
    whole = {r.fp: r.root for r in simhash.groups(prints).collect()}
    monkeypatch.setattr(simhash, "SHARD", 16)
    split = {r.fp: r.root for r in simhash.groups(prints).collect()}
    assert whole == split == classes(set(whole), lambda a, b: (a ^ b).bit_count() <= 4)


def test_more_blocks_for_more_rows():
    assert simhash._blocks(1000, 4) == 5 and simhash._blocks(10**7, 4) == 6 and simhash._blocks(10**11, 4) == 8


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, 301)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 301: 300}


def test_one_row_per_group_stays(spark):
    rows = some_docs()
    got = simhash.first_of_each(docs(spark, rows))
    assert got.columns == docs(spark, []).columns
    kept = sorted((r.doc_id for r in got.collect()), key=lambda d: (d is None, d))
    groups = {(r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert [d for d in kept if d is not None] == sorted(g for g in groups if g is not None)


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.first_of_each(docs(spark, [])).count() == 0
