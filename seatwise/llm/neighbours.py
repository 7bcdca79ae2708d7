"""Approximate nearest neighbours by cosine: randomly rotated one-bit codes with error bounds, then exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatwise.llm.common import stored

# Width of the error bound, in standard deviations of the estimate.
SURE = 3.5
SEED = 6
# Bytes of queries that go to every task at a time; more queries make more rounds.
ROUND_BYTES = 32 << 20
# Codes of a vector: each one is of what those before it leave over.
LEVELS = 3
# Queries that meet codes at once, and codes: as many pairs as a core's cache takes.
TOGETHER, BLOCK = 128, 2048


def usable(vector: str) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class Space:
    """What codes and queries share: a rotation per level and the centre of all unit vectors."""

    def __init__(self, centre: np.ndarray):
        self.size, self.centre = len(centre), centre
        self.turns = [rotation(len(centre), SEED + 1000 * k) for k in range(LEVELS)]

    def turned(self, apart: np.ndarray) -> np.ndarray:
        """In the axes of every level, side by side."""
        return np.hstack([apart @ turn for turn in self.turns])

    def encode(self, rows: np.ndarray):
        """Packed signs of the rotated difference to the centre, level by level (each of the rest that the levels before
        leave), a scale per level, the length of the error and the inner product with the centre.

        The scaled signs add up to a vector whose error is at right angles to the difference itself, in a direction that the
        rotations make uniform: the estimate of an inner product is unbiased and its deviation is known from the error's length."""
        apart = _unit(rows) - self.centre
        rest, bits, scales = apart, [], []
        for turn in self.turns:
            side = rest @ turn
            bits.append(np.packbits(side > 0, axis=1))
            scales.append(np.abs(side).mean(axis=1))
            rest = rest - scales[-1][:, None] * (np.where(side > 0, 1.0, -1.0) @ turn.T)
        square = np.einsum("ij,ij->i", apart, apart)
        agree = square - np.einsum("ij,ij->i", apart, rest)
        up = np.where(agree > 0, square / np.where(agree > 0, agree, 1.0), 0.0)
        error = np.linalg.norm(apart - up[:, None] * (apart - rest), axis=1)
        return np.hstack(bits), np.stack(scales, axis=1) * up[:, None], error, (apart + self.centre) @ self.centre

    def codes(self, bits: np.ndarray, scales: np.ndarray) -> np.ndarray:
        """The scaled signs of all levels, side by side."""
        packed = bits.reshape(len(bits), LEVELS, -1)
        signs = np.unpackbits(packed, axis=2, count=self.size).astype(np.float32) * 2 - 1
        return (signs * scales[:, :, None].astype(np.float32)).reshape(len(bits), -1)


def _coder(space: Broadcast):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            bits, scales, error, on_centre = space.value.encode(_matrix(batch.column("vector"), space.value.size))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vector"), pa.array([b.tobytes() for b in bits], pa.binary()),
                 pa.array([c.tobytes() for c in scales], pa.binary()), pa.array(error), pa.array(on_centre)],
                ["id", "vector", "bits", "scales", "error", "on_centre"],
            )

    return code


_INDEX = "id long, vector array<double>, bits binary, scales binary, error double, on_centre double"


def usable_rows(vectors: DataFrame) -> DataFrame:
    """id, vector (in double precision) of the rows of ``vectors(id, vector)`` that take part."""
    own = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    return own.filter(usable("vector") & F.col("id").isNotNull())


def build_index(own: DataFrame) -> tuple[DataFrame, Broadcast]:
    """Codes of ``own(id, vector)``, all of one length, written to the shared folder, and their space.

    The centre is the mean over all rows; nothing is sampled.
    """
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    each = own.select(F.posexplode("vector").alias("i", "x"), norm.alias("norm"))
    centre = each.groupBy("i").agg(F.avg(F.col("x") / F.col("norm")).alias("m")).orderBy("i").toArrow()
    centre = np.nan_to_num(centre.column("m").to_numpy())
    space = own.sparkSession.sparkContext.broadcast(Space(centre))
    return stored(own.mapInArrow(_coder(space), _INDEX), "codes"), space


class Queries:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, space: Space):
        self.ids, self.rows, self.norm = ids, rows, np.linalg.norm(rows, axis=1)
        unit = _unit(rows)
        apart = unit - space.centre
        self.length = np.linalg.norm(apart, axis=1)
        on_centre = unit @ space.centre - space.centre @ space.centre
        # Times a code with (inner product with the centre, 1, error) behind it: the upper end of the estimate.
        behind = np.stack([np.ones(len(rows)), on_centre + 1e-5, self.length], axis=1)
        self.high = np.hstack([space.turned(apart), behind]).astype(np.float32)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of paired rows, in double precision."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _finder(queries: Broadcast, space: Broadcast, k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, size = queries.value, space.value.size
        best = np.full((len(q.ids), k), -np.inf)
        who = np.full((len(q.ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            if not len(batch):
                continue
            ids, rows = batch.column("id").to_numpy(), _matrix(batch.column("vector"), size)
            # Of equal vectors only the k + 1 smallest ids can be among the nearest.
            _, same = np.unique(rows, axis=0, return_inverse=True)
            order = np.lexsort((ids, same.ravel()))
            start = np.flatnonzero(np.r_[True, np.diff(same.ravel()[order]) != 0])
            place = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
            kept = order[place <= k]
            ids, rows = ids[kept], rows[kept]
            packed, scales = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(len(batch), -1)[kept]
                for c, t in (("bits", np.uint8), ("scales", np.float64))
            )
            error, on_centre = (batch.column(c).to_numpy()[kept] for c in ("error", "on_centre"))
            spread = error / np.sqrt(max(size - 1, 1)) * SURE
            behind = np.stack([on_centre, np.ones(len(ids)), spread], axis=1).astype(np.float32)
            codes = np.hstack([space.value.codes(packed, scales), behind])
            for from_ in range(0, len(ids), BLOCK):
                block = slice(from_, from_ + BLOCK)
                some, some_ids, some_rows = codes[block], ids[block], rows[block]
                for low in range(0, len(q.ids), TOGETHER):
                    part = slice(low, low + TOGETHER)
                    high = q.high[part] @ some.T
                    need = best[part, -1].copy()
                    unsure = np.flatnonzero(np.isneginf(need))
                    if len(unsure) and len(some_ids) > k:
                        # Fewer than k rows compared yet: the k that look nearest, compared, bound what is needed.
                        look = np.where(q.ids[part][unsure, None] == some_ids, -np.inf, high[unsure])
                        first = np.argpartition(look, len(some_ids) - k, axis=1)[:, len(some_ids) - k :]
                        score = _cosines(q.rows[low + np.repeat(unsure, k)], some_rows[first.ravel()]).reshape(-1, k)
                        sure = np.isfinite(np.take_along_axis(look, first, axis=1)).all(axis=1)
                        need[unsure] = np.where(sure, score.min(axis=1), -np.inf)
                    a, b = np.nonzero(high >= need[:, None].astype(np.float32))
                    apart = q.ids[low + a] != some_ids[b]
                    a, b = a[apart], b[apart]
                    for cut in range(0, len(a), 1 << 13):
                        a_, b_ = a[cut : cut + (1 << 13)], b[cut : cut + (1 << 13)]
                        score = _cosines(q.rows[low + a_], some_rows[b_])
                        better = score >= best[low + a_, -1]
                        a_, b_, score = a_[better], b_[better], score[better]
                        touched = np.unique(a_)
                        all_q = np.r_[np.repeat(touched, k), a_]
                        all_s = np.r_[best[low + touched].ravel(), score]
                        all_i = np.r_[who[low + touched].ravel(), some_ids[b_]]
                        order = np.lexsort((all_i, -all_s, all_q))
                        first = np.searchsorted(all_q[order], touched)
                        top = order[first[:, None] + np.arange(k)]
                        best[low + touched], who[low + touched] = all_s[top], all_i[top]
        a, b = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q.ids[a]), pa.array(who[a, b]), pa.array(best[a, b])], ["query_id", "vec_id", "score"])

    return find


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each usable row of ``vectors(id, vector)`` that is a query, its k nearest
    other rows by cosine, nearest first, ties to the smaller id; fewer if there are fewer.

    Each code gives an estimate of the cosine and a bound of its error. Rows that can still be among the k best
    by their upper bound are compared exactly, in the task that holds them. Queries
    go to the tasks in rounds of bounded size, chosen by a hash of the id. Rows that repeat a query's id are no
    candidates for it; other repeated rows are candidates one by one; of queries with one id and length one is taken.
    A cosine needs vectors of one length, so each length is searched on its own; a query id with vectors of
    several lengths gets its k nearest over them.
    """
    own = usable_rows(vectors)
    # Distinct lengths are at most the root of twice the numbers stored.
    sizes = sorted(r["size"] for r in own.groupBy(F.size("vector").alias("size")).count().collect())
    found = [r for n in sizes for r in _found(own.filter(F.size("vector") == n), is_query, k)]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = all_.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _found(own: DataFrame, is_query: Column, k: int) -> list[DataFrame]:
    """(query_id, vec_id, score) of the k best of every task among vectors of one length, a table for each round of queries."""
    index, space = build_index(own)
    spark = own.sparkSession
    asked = index.filter(is_query).groupBy("id").agg(F.min("vector").alias("vector"))
    rounds = max(1, -(-asked.count() * space.value.size * 24 // ROUND_BYTES))
    results = []
    for i in range(rounds):
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == i).toArrow().combine_chunks().sort_by("id")
        if not len(own):
            continue
        rows = _matrix(own.column("vector").combine_chunks(), space.value.size)
        queries = spark.sparkContext.broadcast(Queries(own.column("id").to_numpy(), rows, space.value))
        found = index.mapInArrow(_finder(queries, space, k), "query_id long, vec_id long, score double")
        results.append(found)
    return results
