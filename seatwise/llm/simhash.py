"""Near-duplicates by SimHash: fingerprints of word shingles, linked by radius with BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import cut_lineage, ids_and_text, numbered, words
from seatwise.llm.components import components

SHINGLE = 4
RADIUS = 4
# A bucket of more fingerprints is split into shards that meet pair by pair.
SHARD = 8192
# Query rows times bucket rows that one step of a tree walk may hold.
STEP = 1 << 21


def shingle_hashes(tokens: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, or of all words if there are fewer (at least one)."""
    line = b" ".join(tokens)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(line)]
    n = max(1, len(tokens) - shingle + 1)
    pieces = map(line.__getitem__, map(slice, starts[:n], ends[min(shingle, len(tokens)) - 1 :]))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, n)


def print_of(hashes: np.ndarray) -> int:
    """64 bits: each is 1 if it is set in over half of the hashes. No hashes: 0."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        octets = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n).view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The print of all shingles' XXH64. No words: 0."""
    tokens = words(text)
    return print_of(shingle_hashes(tokens, shingle)) if tokens else 0


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.fromiter((fingerprint(t or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pd.Series(found.view(np.int64))

    return prints(text)


class Forest:
    """One BK-tree per group over distinct 64-bit values, built and walked level by level."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        """``group`` is ascending; the first value of a group is its root."""
        n = len(values)
        self.values = values
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        self.root = dict(zip(group[first].tolist(), first.tolist()))
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        at = np.repeat(first, np.diff(np.r_[first, n]))
        waiting = np.setdiff1d(np.arange(n), first)
        while waiting.size:
            far = np.bitwise_count(values[waiting] ^ values[at[waiting]]).astype(np.int64)
            order = np.argsort(at[waiting] * 65 + far, kind="stable")
            waiting, far = waiting[order], far[order]
            new = np.r_[True, (np.diff(at[waiting]) != 0) | (np.diff(far) != 0)]
            child = waiting[new]
            parent[child], edge[child] = at[child], far[new]
            at[waiting] = np.repeat(child, np.diff(np.r_[np.flatnonzero(new), len(new)]))
            waiting = np.sort(waiting[~new])
        nodes = np.flatnonzero(parent >= 0)
        key = parent[nodes] * 65 + edge[nodes]
        order = np.argsort(key, kind="stable")
        self.children, self.key = nodes[order], key[order]

    def near(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query position, node) of all values within ``radius``, following the edges
        whose distance differs from the node's own by at most ``radius``."""
        which, node = np.arange(len(queries)), roots
        while which.size:
            far = np.bitwise_count(queries[which] ^ self.values[node]).astype(np.int64)
            hit = far <= radius
            yield which[hit], node[hit]
            low = np.searchsorted(self.key, node * 65 + np.maximum(far - radius, 1))
            high = np.searchsorted(self.key, node * 65 + np.minimum(far + radius, 64), side="right")
            width = high - low
            which = np.repeat(which, width)
            step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            node = self.children[np.repeat(low, width) + step]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the classes of a[i] and b[i]; ``label`` holds the smallest position of a class."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (deeper := label[label]).tobytes() != label.tobytes():
            label[:] = deeper


def _links_of(values: np.ndarray, group: np.ndarray, tree: np.ndarray, query: np.ndarray, radius: int):
    """Pairs of values that connect what is within ``radius`` in a group: one per value at most."""
    spot = np.flatnonzero(tree)
    forest = Forest(values[spot], group[spot])
    ask = np.flatnonzero(query)
    ask = ask[[g in forest.root for g in group[ask].tolist()]] if len(ask) else ask
    roots = np.array([forest.root[g] for g in group[ask].tolist()], np.int64)
    size = np.bincount(group[spot], minlength=int(group.max()) + 1)[group[ask]] if len(ask) else ask
    cut = np.flatnonzero(np.diff(np.cumsum(size) // STEP)) + 1
    label = np.arange(len(values))
    for part, start in zip(np.split(ask, cut), np.split(roots, cut)):
        for q, node in forest.near(values[part], start, radius):
            _join(label, part[q], spot[node])
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def _search(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def answer(rows: pa.Table) -> pa.RecordBatch:
        column = lambda c: rows.column(c).to_numpy()
        lo, hi, own = column("lo"), column("hi"), column("own")
        changed = np.zeros(len(rows), bool)
        for c in ("bucket", "lo", "hi"):
            changed[1:] |= np.diff(column(c)) != 0
        a, b = _links_of(column("fp").view(np.uint64), np.cumsum(changed), own == lo, own == hi, radius)
        return pa.RecordBatch.from_arrays([a.view(np.int64), b.view(np.int64)], schema=schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < 1 << 17:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            ends = np.zeros(len(rows) - 1, bool)
            for c in ("bucket", "lo", "hi"):
                ends |= np.diff(rows.column(c).to_numpy()) != 0
            whole = int(np.flatnonzero(ends)[-1]) + 1 if ends.any() else 0
            if whole:
                yield answer(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
        if held and sum(map(len, held)):
            yield answer(pa.Table.from_batches(held).combine_chunks())

    return search


def _blocks(n: int, radius: int) -> int:
    """So many blocks that a bucket gets a few hundred of n evenly spread fingerprints."""
    blocks = radius + 1
    while (blocks - radius) * 64 / blocks < np.log2(max(n, 2)) - 8 and blocks < 2 * radius:
        blocks += 1
    return blocks


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of the distinct ``fp`` of ``prints`` that connect all fingerprints at
    ``radius`` or fewer differing bits, directly or over others; a spanning forest per bucket.

    With m blocks of bits, two such fingerprints agree on m - radius whole blocks, so they meet
    in a bucket of some choice of blocks. A bucket's tree holds up to SHARD values; a larger
    bucket is split, and each pair of its shards meets in a task of its own.
    """
    m = _blocks(prints.count(), radius)
    cuts = [round(64 * i / m) for i in range(m + 1)]
    fp = F.col("fp")
    keys = []
    for table, chosen in enumerate(combinations(range(m), m - radius)):
        key = F.lit(table).cast("long")
        for i in chosen:
            width = cuts[i + 1] - cuts[i]
            bits = F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(bits)
        keys.append(key)
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    full = rows.groupBy("bucket").count().filter(F.col("count") > SHARD)
    full = full.select("bucket", F.ceil(F.col("count") / (SHARD // 2)).cast("int").alias("n"))
    rows = rows.join(full, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    rows = rows.select("bucket", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    rows = rows.select(
        "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fp"
    )
    placed = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "fp")
    return placed.mapInArrow(_search(radius), "a long, b long")


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root) for each distinct ``fp``: the same root for all that reach each other."""
    distinct = cut_lineage(prints.select("fp").distinct())
    linked = components(links(distinct, radius))
    both = distinct.join(linked, distinct["fp"] == linked["node"], "left")
    return both.select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed 64 bits) and component_id, the smallest doc_id that is reachable over
    links of ``radius`` or fewer differing bits, one row per row of ``docs(doc_id, text)``.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows are
    kept. A null doc_id never names a component, unless it is the only one there (null).
    """
    prints = ids_and_text(docs).select("doc_id", fingerprint_column(F.col("text"), shingle).alias("fp"))
    prints = cut_lineage(prints)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = groups(prints, radius).join(least, "fp")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return prints.join(named.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, one per group of near-duplicates: that of the smallest doc_id, null last, and
    of repeated rows any one."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    held = numbered(docs, "prints", fingerprint_column(text, shingle).alias("fp"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "n"))
    prints = held.select("n", F.col("row.doc_id").alias("doc_id"), "fp")
    # One row per fingerprint before the join, however many copies share it.
    firsts = prints.groupBy("fp").agg(least.alias("k"))
    kept = firsts.join(groups(prints, radius), "fp").groupBy("root").agg(F.min("k").alias("k")).select("k.n")
    return held.join(kept, "n", "left_semi").select("row.*")
