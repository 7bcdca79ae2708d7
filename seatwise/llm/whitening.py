"""Whitening of embeddings from an exact covariance found by polarisation.

The covariance of two dimensions is half of var(a + b) - var(a) - var(b). So only squares are summed: of
every centred dimension and of every sum of two. All of it is integer arithmetic without rounding: entries
become integers x, they are centred on the integer m nearest to the mean S/n before they are
squared, and what that leaves, r = S - n*m, is taken off exactly:
sum (n*(x-m) - r)^2 = n * (n * sum (x-m)^2 - r^2).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
# An entry that has no long x (beyond 2^61) makes its vector drop out, like one that is not finite.
LARGEST = float(1 << 61) / SCALE
# Cells (dimensions squared) of all vector lengths that are fitted in one round.
ROUND_CELLS = 1 << 24
# Numbers of a block in a task: rows x dimensions.
BLOCK = 1 << 18
_LOW = (1 << 64) - 1


def usable(vector: str) -> Column:
    """True for vectors without null, non-finite or too large entries."""
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST))
    return F.col(vector).isNotNull() & fine


def _blocks(batches: Iterator[pa.RecordBatch], id_too: bool = False) -> Iterator[tuple]:
    """(x as rows of one length, ids) of at most BLOCK numbers, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("vector"))
        lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            step = max(1, BLOCK // max(1, int(size)))
            for i in range(0, len(at), step):
                part = pa.array(at[i : i + step])
                flat = column.take(part).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x = np.floor(flat * SCALE).astype(np.int64).reshape(-1, int(size)) + SHIFT
                yield (x, batch.column(0).take(part)) if id_too else x


def _sum(a: np.ndarray, most: int) -> list[int]:
    """Exact column sums of integers, none larger than ``most`` in size."""
    if most * max(1, len(a)) < 1 << 62:
        return a.sum(axis=0).tolist()
    return a.astype(object).sum(axis=0).tolist()


def _peak(a: np.ndarray) -> int:
    return max(abs(int(a.min())), abs(int(a.max()))) if a.size else 0


_TOTALS = pa.schema([("size", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("high", pa.decimal128(38, 0)), ("low", pa.decimal128(38, 0))])
_TOTALS_DDL = "size int, i int, j int, high decimal(38,0), low decimal(38,0)"


def _emit(size: int, i: list[int], j: list[int], totals: list[int]) -> pa.RecordBatch:
    """Totals of any size, split at 2^64 so that their sums stay exact."""
    kind = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays([
        pa.array([size] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
        pa.array([Decimal(t >> 64) for t in totals], kind), pa.array([Decimal(t & _LOW) for t in totals], kind),
    ], schema=_TOTALS)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per vector length: the number of rows (i = -1) and the sum of each dimension."""
    held: dict[int, list] = {}
    for x in _blocks(batches):
        size = x.shape[1]
        n, sums = held.setdefault(size, [0, np.zeros(size, object)])
        held[size] = [n + len(x), sums + np.array(_sum(x, _peak(x)), object)]
    for size, (n, sums) in held.items():
        yield _emit(size, [-1, *range(size)], [-1] * (size + 1), [n, *sums.tolist()])


@dataclass
class Centre:
    """Of one vector length: its rows, the sum of each dimension, and the integers nearest to the means."""

    n: int
    sums: list[int]

    @property
    def middle(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]


def _squares(centres: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per vector length: the sum of squares of every centred dimension (i, i) and of every sum of two (i, j)."""
        held: dict[int, list[np.ndarray]] = {}
        for x in _blocks(batches):
            size = x.shape[1]
            d = x - np.array(centres.value[size].middle, np.int64)
            if size not in held:
                held[size] = [np.zeros(size - i, object) for i in range(size)]
            square = 4 * _peak(d) ** 2
            if square * max(1, len(d)) >= 1 << 62:
                d = d.astype(object)
            for i, total in enumerate(held[size]):
                both = d[:, i:] + d[:, i : i + 1]
                both[:, 0] = d[:, i]
                # Column sums of squares; the bound above keeps a block's within 64 bits.
                found = (both * both).sum(axis=0) if both.dtype == object else np.einsum("ij,ij->j", both, both)
                total += found.astype(object)
        for size, rows in held.items():
            for i, totals in enumerate(rows):
                yield _emit(size, [i] * (size - i), list(range(i, size)), totals.tolist())
    return run


def _totals(emitted: DataFrame) -> DataFrame:
    return emitted.groupBy("size", "i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))


def _whole(row) -> int:
    return (int(row["high"]) << 64) + int(row["low"])


_SPECTRUM = "size int, component int, direction array<double>, value double, explained double"


def _spectrum(centres: Broadcast, components: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The first eigenvectors of one vector length from its (size + 1) * size / 2 totals."""
        size = int(pdf["size"].iloc[0])
        centre = centres.value[size]
        n, rest = centre.n, [s - centre.n * m for s, m in zip(centre.sums, centre.middle, strict=True)]
        single: dict[int, int] = {}
        pairs = []
        for i, j, high, low in zip(pdf["i"], pdf["j"], pdf["high"], pdf["low"], strict=True):
            total = (int(high) << 64) + int(low)
            if i == j:
                single[int(i)] = n * total - rest[i] ** 2
            else:
                pairs.append((int(i), int(j), n * total - (rest[i] + rest[j]) ** 2))
        v = np.zeros((size, size))
        for i, total in single.items():
            v[i, i] = total / n**2
        for i, j, total in pairs:
            v[i, j] = v[j, i] = (total - single[i] - single[j]) / (2 * n**2)
        values, vectors = np.linalg.eigh(v)
        trace = sum(single.values()) / n**2
        # Rounding leaves about this much where there is no variance.
        least = trace * size * np.finfo(float).eps
        out = []
        for k in range(min(components, size)):
            e, w = float(values[-1 - k]), vectors[:, -1 - k]
            w = w * np.sign(w[np.argmax(np.abs(w))])
            e = e if e > least else 0.0
            out.append((size, k + 1, w.tolist(), e, e / trace if trace else 0.0))
        return pd.DataFrame(out, columns=["size", "component", "direction", "value", "explained"])
    return run


@dataclass
class Axes:
    """What projects vectors of one length: directions divided by the standard deviations (0 without variance)."""

    centre: Centre
    scaled: np.ndarray
    explained: list[float]
    error: float = 0.0


def _project(x: np.ndarray, axes: Axes) -> tuple[np.ndarray, np.ndarray | list[int]]:
    """Whitened values and exact deviations: n*x - S is an integer, centred before it is multiplied."""
    n, sums = axes.centre.n, axes.centre.sums
    most = n * _peak(x) + max(map(abs, sums), default=0)
    kind = np.int64 if most < 1 << 62 else object
    y = x.astype(kind) * n - np.array(sums, kind)
    white = (y.astype(np.float64) / n) @ axes.scaled.T
    if most**2 * max(1, x.shape[1]) >= 1 << 62:
        peak = _peak(y)
        if peak < 1 << 52 and kind is np.int64:  # squares in two halves of 26 bits
            high, low = y >> 26, y & ((1 << 26) - 1)
            parts = [np.einsum("ij,ij->i", a, b).astype(object) for a, b in ((high, high), (high, low), (low, low))]
            if (peak >> 26) ** 2 * x.shape[1] < 1 << 62:
                return white, (parts[0] * (1 << 52) + parts[1] * (1 << 27) + parts[2]).tolist()
        y = y.astype(object)
        return white, (y * y).sum(axis=1).tolist()
    return white, np.einsum("ij,ij->i", y, y).tolist()


_CHECK = pa.schema([("size", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("total", pa.float64())])


def _check(axes: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of whitened values (j = -1) and of their products."""
        held: dict[int, np.ndarray] = {}
        for x in _blocks(batches):
            of = axes.value[x.shape[1]]
            white, _ = _project(x, of)
            k = white.shape[1]
            table = held.setdefault(x.shape[1], np.zeros((k, k + 1)))
            table[:, :k] += white.T @ white
            table[:, k] += white.sum(axis=0)
        for size, table in held.items():
            k = len(table)
            i, j = np.indices(table.shape)
            j[:, k] = -1
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(table.size, size, np.int32)), pa.array(i.ravel().astype(np.int32)),
                pa.array(j.ravel().astype(np.int32)), pa.array(table.ravel()),
            ], schema=_CHECK)
    return run


_OUT = pa.schema([
    ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()),
    ("explained", pa.float64()), ("identity_error", pa.float64()), ("deviation_digits", pa.string()),
])
_OUT_DDL = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double, deviation_digits string"
)


def _apply(axes: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, ids in _blocks(batches, id_too=True):
            of = axes.value[x.shape[1]]
            k = len(of.explained)
            if not k:
                continue
            white, deviations = _project(x, of)
            rows = np.repeat(np.arange(len(x)), k)
            small = [d if d < 1 << 63 else None for d in deviations]
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(rows), of.centre.n, np.int64)), pa.array(small, pa.int64()).take(pa.array(rows)),
                pa.array(white.ravel()), pa.array(np.tile(np.array(of.explained), len(x))),
                pa.array(np.full(len(rows), of.error)), pa.array(list(map(str, deviations))).take(pa.array(rows)),
            ], schema=_OUT)
    return run


def _rounds(sizes: list[int]) -> list[list[int]]:
    out, cells = [[]], 0
    for size in sizes:
        if out[-1] and cells + size * size > ROUND_CELLS:
            out, cells = [*out, []], 0
        out[-1].append(size)
        cells += size * size
    return out


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of the vectors of ``rows`` (vec_id, vector): a row per vector and component.

    Columns: vec_id, component (from 1, by falling eigenvalue), n (vectors in the fit), deviation (the exact sum over
    dimensions of (n*x - S)^2; null beyond a long, for which deviation_digits has all digits), whitened,
    explained, identity_error, deviation_digits. Null vectors and those with null, non-finite or too large entries take
    no part. A covariance needs vectors of one length, so each length is a fit of its own;
    vectors of no entries have no component and give no rows. Repeated rows count each; a null vec_id is kept. A direction without
    variance has whitened value 0 and stays out of identity_error. An empty table gives no rows.

    The table is read four times: sums, squares, the check against the identity, the result. What a task
    sends is size * (size + 1) / 2 totals per vector length. The driver gets a row per distinct length and
    dimension, and the components; a length's covariance is assembled in a task.
    """
    spark = rows.sparkSession
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").filter(usable("vector"))
    vectors = good.select("vector")
    # Distinct lengths are at most the root of twice the numbers stored.
    sizes = sorted(r["size"] for r in vectors.groupBy(F.size("vector").alias("size")).count().collect() if r["size"])
    parts = []
    for some in _rounds(sizes):
        of_round = F.size("vector").isin(some)
        found = _totals(vectors.filter(of_round).mapInArrow(_moments, _TOTALS_DDL)).orderBy("size", "i").collect()
        centres: dict[int, Centre] = {}
        for r in found:
            if r["i"] < 0:
                centres[r["size"]] = Centre(_whole(r), [])
            else:
                centres[r["size"]].sums.append(_whole(r))
        known = spark.sparkContext.broadcast(centres)
        squares = _totals(vectors.filter(of_round).mapInArrow(_squares(known), _TOTALS_DDL))
        spectrum = squares.groupBy("size").applyInPandas(_spectrum(known, components), _SPECTRUM)
        axes: dict[int, Axes] = {}
        for r in spectrum.orderBy("size", "component").collect():
            of = axes.setdefault(r["size"], Axes(centres[r["size"]], np.zeros((0, r["size"])), []))
            by = np.array(r["direction"]) / (np.sqrt(r["value"]) if r["value"] else np.inf)
            of.scaled, of.explained = np.vstack([of.scaled, by]), [*of.explained, r["explained"]]
        sent = spark.sparkContext.broadcast(axes)
        checks = vectors.filter(of_round).mapInArrow(_check(sent), "size int, i int, j int, total double")
        sums = {
            (r["size"], r["i"], r["j"]): r["total"]
            for r in checks.groupBy("size", "i", "j").agg(F.sum("total").alias("total")).collect()
        }
        for size, of in axes.items():
            n, live = of.centre.n, [k for k, e in enumerate(of.explained) if e]
            of.error = max((
                abs(sums[size, i, j] / n - sums[size, i, -1] / n * sums[size, j, -1] / n - (i == j))
                for i in live for j in live
            ), default=0.0)
        final = spark.sparkContext.broadcast(axes)
        parts.append(good.filter(of_round).mapInArrow(_apply(final), _OUT_DDL))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
