"""Benchmark decontamination: a prefix-filtered join of item windows with documents."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import cut_lineage, ids_and_text, numbered

WINDOW = 13
# Words per shingle, the token of the prefix filter; shorter windows use what they have.
SHINGLE = 3
SHARE = 20

_SPACED = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PROBES = 3


def item_words(text: bytes) -> list[bytes]:
    """ASCII letters (in lower case), digits and all beyond ASCII make words."""
    return text.translate(_SPACED).split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(29))


def _hashes(words: list[bytes]) -> np.ndarray:
    return _mixed(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + _ODD)


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words. Equal hashes of unequal runs cost a check, no more."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = _mixed(out + hashes[i : i + n])
    return out


class Bits:
    """A Bloom filter over 64-bit hashes. Its size is ``bits``, whatever it holds."""

    def __init__(self, bits: int, at: np.ndarray, word: np.ndarray):
        self.bits = bits
        longs = np.zeros(bits // 64, "<i8")
        longs[at] = word
        self.field = longs.view(np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Positions whose hash may be held."""
        found = np.arange(len(hashes))
        for place in range(_PROBES):
            at = (hashes[found] >> np.uint64(16 * place)) & np.uint64(self.bits - 1)
            found = found[(self.field[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return found


def _bloom(tokens: DataFrame, n: int) -> Broadcast:
    """The filter of ``tokens(token)``: 64 bits for each, 2^20 at least and 2^30 at most, so that
    what the driver sends is at most 128 MB. Its words are put together in Spark."""
    bits = 1 << max(20, min(30, (64 * n).bit_length()))
    mask = F.lit(bits - 1).cast("long")
    places = [F.shiftrightunsigned("token", 16 * i).bitwiseAND(mask) for i in range(_PROBES)]
    at = tokens.select(F.explode(F.array(*places)).alias("p"))
    word = F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))"))
    rows = at.groupBy(F.shiftright("p", 6).alias("at")).agg(word.alias("word")).toArrow()
    filled = Bits(bits, rows.column("at").to_numpy(), rows.column("word").to_numpy())
    return tokens.sparkSession.sparkContext.broadcast(filled)


def windows(text: Column, window: int = WINDOW, shingle: int = SHINGLE) -> Column:
    """Of an item: all windows with their shingles' hashes. No words: none."""

    @F.pandas_udf("array<struct<win:string,tokens:array<long>>>")
    def cut(texts: pd.Series) -> pd.Series:
        def of(text):
            words = item_words(text or b"")
            size = min(window, len(words))
            token = _shingles(_hashes(words), min(shingle, size)) if size else ()
            per = size - min(shingle, size) + 1
            return [
                {"win": b" ".join(words[i : i + size]).decode(), "tokens": token[i : i + per].view(np.int64).tolist()}
                for i in range(len(words) - size + 1 if size else 0)
            ]

        return texts.map(of)

    return cut(text)


def _count(sizes: list[int], held: Broadcast):
    """Corpus counts of the shingles that the items have."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            rows = [pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(rows, schema=schema)

        for batch in batches:
            for text in batch.column("text"):
                hashes = _hashes(item_words(text.as_py()))
                for size in sizes:
                    tokens = _shingles(hashes, size)
                    seen.update(tokens[held.value.has(tokens)].view(np.int64).tolist())
                if len(seen) > 1 << 18:
                    yield out()
                    seen.clear()
        yield out()

    return count


def _candidates(text: Column, sizes: list[int], held: Broadcast, window: int) -> Column:
    """Words of a text, and where it may have a prefix token, with the words around it."""

    @F.pandas_udf("n_words long, near array<struct<token:long,at:int,low:int,context:array<string>>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            counts, near = [], []
            for text in texts:
                words = item_words(text or b"")
                hashes, found = _hashes(words), []
                for size in sizes:
                    tokens = _shingles(hashes, size)
                    for at in held.value.has(tokens).tolist():
                        low = max(0, at - window + 1)
                        around = [w.decode() for w in words[low : at + window]]
                        token = int(tokens[at : at + 1].view(np.int64)[0])
                        found.append({"token": token, "at": at, "low": low, "context": around})
                counts.append(len(words))
                near.append(found)
            yield pd.DataFrame({"n_words": counts, "near": near})

    return find(text)


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = SHARE
) -> tuple[DataFrame, DataFrame]:
    """What ``docs(doc_id, text)`` have of ``items(item_id, text)``: per document row
    (row, doc_id, n_words, n_hit, item_ids, contaminated), and its hit spans
    (row, low, high, win), ends exclusive, in words.

    A document has a window whole, so it has the window's rarest shingle, its prefix: shingles are
    ordered by their count in the corpus, and only prefixes are looked up in documents, first in
    a Bloom filter of bounded size. A place that passes carries the words around it; the join by
    token gives windows, the token's offset in the window bounds where it can begin and
    end, and the words are then compared. Null and empty texts have no words; an item without
    words has no windows; rows with one item_id are one item; a null item_id reads as empty text.
    """
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                         F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    found = cut_lineage(items.select("item_id", F.explode(windows(F.col("text"), window, shingle)).alias("w")))
    owned = found.select("item_id", F.col("w.win").alias("win")).distinct()
    wins = found.groupBy(F.col("w.win").alias("win")).agg(F.first("w.tokens").alias("tokens"))
    size = F.size(F.split("win", " ", -1)).alias("size")
    wins = cut_lineage(wins.select("win", "tokens", size))
    lengths = wins.select(F.least("size", F.lit(shingle)).alias("k")).distinct()
    sizes = sorted(r.k for r in lengths.collect())

    texts = ids_and_text(docs)
    tokens = wins.select(F.explode("tokens").alias("token")).distinct()
    in_corpus = texts.select("text").mapInArrow(_count(sizes, _bloom(tokens, tokens.count())), "token long, n long")
    common = in_corpus.groupBy("token").agg(F.sum("n").alias("n"))
    each = wins.select("win", "size", F.posexplode("tokens").alias("offset", "token"))
    each = each.join(common, "token", "left")
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")
    prefix = each.groupBy("win", "size").agg(F.min(rank).alias("p"))
    prefix = cut_lineage(prefix.select("win", "size", "p.token", "p.offset"))

    held = _bloom(prefix.select("token").distinct(), prefix.count())
    seen = _candidates(F.col("text"), sizes, held, window)
    rows = texts.select("doc_id", seen.alias("s")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "s.n_words", "s.near"
    )
    rows = cut_lineage(rows)
    near = rows.select("row", "n_words", F.explode("near").alias("c")).select("row", "n_words", "c.*")
    low = F.col("at") - F.col("offset")
    fits = (low >= 0) & (low + F.col("size") <= F.col("n_words"))
    same = F.array_join(F.slice("context", low - F.col("low") + 1, F.col("size")), " ") == F.col("win")
    hits = near.join(prefix, "token").filter(fits).filter(same)
    spans = hits.select("row", low.alias("low"), (low + F.col("size")).alias("high"), "win").distinct()
    of_row = spans.groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("at"))
    gain = lambda a, x: F.greatest(x.high - F.greatest(x.low, a.upto), F.lit(0))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda a, x: F.struct((a.n + gain(a, x)).alias("n"), F.greatest(a.upto, x.high).alias("upto"))
    n_hit = F.aggregate(F.array_sort("at"), start, step, lambda a: a.n).cast("long").alias("n_hit")
    of_item = spans.select("row", "win").distinct().join(owned, "win").groupBy("row").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids")
    )
    hit = of_row.select("row", n_hit).join(of_item, "row")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    report = rows.drop("near").join(hit, "row", "left").select(
        "row", "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )
    return report, spans


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    held = numbered(docs, "clean")
    report, _ = contamination(held.select(F.col("n").alias("doc_id"), F.col("row.text").alias("text")), items)
    found = report.filter("contaminated").select(F.col("doc_id").alias("n"))
    return held.join(found, "n", "left_anti").select("row.*")
