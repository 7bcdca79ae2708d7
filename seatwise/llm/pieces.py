"""SentencePiece BPE: encoding by vectorised merge rounds, and decoding, with tables of a given model.

The model's tables are made once on the driver and broadcast (a row per piece and per way to put a piece together
from two); tasks need neither the file nor its library. A text is cut into words where no piece can span the cut.
Each distinct word of a batch is encoded once: all their symbols lie in one flat array, and in each round every word
merges the pair of smallest rank, wherever it stands, until no word has a pair.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "\u2581"
# Symbols: ids of pieces, then characters that occur only inside pieces, then OTHER + code point.
OTHER = 1 << 21
_SHIFT = 22
_NONE = np.iinfo(np.int32).max
# Code points of text that a task splits into words at a time, and distinct words it remembers.
BLOCK, REMEMBERED = 1 << 20, 1 << 18
# Words of more symbols are cut where no piece can span the cut.
LONG = 256
# What an unknown id decodes to (a fixed value of the library).
UNKNOWN_TEXT = " \u2047 "


class Model:
    """Tables of a BPE model with byte fallback, a dummy prefix and no other normalisation."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self._same_text(sp)
        ids = range(sp.get_piece_size())
        pieces = [sp.id_to_piece(i) for i in ids]
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i)}
        byte_ids = {int(pieces[i][1:-1], 16): i for i in ids if sp.is_byte(i)}
        if len(byte_ids) != 256 or any(sp.is_unused(i) for i in ids):
            raise ValueError("only models with byte fallback and without unused pieces are supported")
        plain = {pieces[i]: i for i in ids if i not in special and not sp.is_byte(i)}

        self.size = len(pieces)
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], np.int32)
        inner = sorted({c for p in plain for c in p} - plain.keys())
        symbols = plain | {c: self.size + k for k, c in enumerate(inner)}
        self.inner = inner
        self.of_code = np.arange(OTHER, OTHER + 0x110000, dtype=np.int32)
        for c, s in symbols.items():
            if len(c) == 1:
                self.of_code[ord(c)] = s

        # Equal scores are one rank: of such pairs the leftmost goes first.
        scores = sorted({sp.get_score(i) for i in plain.values()}, reverse=True)
        rank_of = {score: r for r, score in enumerate(scores)}
        rank = {p: rank_of[sp.get_score(i)] for p, i in plain.items()}
        since = {p: r for p, r in rank.items() if len(p) > 1}  # characters are there from the start
        pairs = sorted(
            ((symbols[p[:k]] << _SHIFT) | symbols[p[k:]], rank[p], i, since.get(p[:k], -1), since.get(p[k:], -1))
            for p, i in plain.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols
        )
        table = np.array(pairs, np.int64).reshape(-1, 5)
        self.pairs = Lookup(table[:, 0])
        self.ranks, self.merged = np.r_[table[:, 1], _NONE].astype(np.int32), np.r_[table[:, 2], 0].astype(np.int32)
        # A merge may open one that comes no later than itself. Of such a rank only a word's leftmost pair is merged in a round.
        self.hasty = np.zeros(len(scores) + 1, bool)
        left_first, right_first = table[:, 1] <= table[:, 3], table[:, 1] <= table[:, 4]
        self.hasty[table[left_first, 3]] = True
        self.hasty[table[right_first, 4]] = True
        # The last rank of all: if no merge of it opens one of an earlier rank, what a word has left
        # is merged in one pass from the left.
        self.last = len(scores) - 1
        opens = (table[:, 3] == self.last) | (table[:, 4] == self.last)
        self.last_by_pass = bool((table[opens, 1] == self.last).all())
        self.last_pairs = {int(k): int(m) for k, r, _, m in table[:, [0, 1, 3, 2]].tolist() if r == self.last}

        # Words begin at spaces after something else, unless a piece spans such a place.
        whole = any(p.lstrip(SPACE).find(SPACE) >= 0 for p in plain)
        self.word = re.compile(".+" if whole else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.DOTALL)
        self.whole = whole
        ends = {(symbols[a] << _SHIFT) | symbols[b] for p in plain for a, b in zip(p, p[1:], strict=False)}
        self.together = Lookup(np.array(sorted(ends), np.int64))

        # What ids decode to.
        out = [b"" if sp.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        for i in special:
            out[i] = UNKNOWN_TEXT.encode() if sp.is_unknown(i) else b""
        for b, i in byte_ids.items():
            out[i] = bytes([b])
        self.texts = Ragged(np.frombuffer(b"".join(out), np.uint8), np.array([len(t) for t in out], np.int64))
        self.is_byte = np.zeros(self.size, bool)
        self.is_byte[self.byte_ids] = True
        self.is_control = np.array([sp.is_control(i) for i in ids])
        self.spaced = np.array([p in plain and p.startswith(SPACE) for p in pieces])

    @staticmethod
    def _same_text(sp) -> None:
        """Raises for models that normalise: their texts would need more than a prefix and space marks."""
        probe = "  a \uff21\u00c5 e\u0301\t\n\u3000x  "
        if sp.normalize(probe) != (SPACE + probe).replace(" ", SPACE):
            raise ValueError("only models without normalisation, with a dummy prefix, are supported")

    def blocks(self, text: str) -> Iterator[str]:
        """The marked text in runs of about BLOCK code points that end where a word ends."""
        marked = (SPACE + text).replace(" ", SPACE)
        start = 0
        while not self.whole and len(marked) - start > BLOCK:
            end = start + BLOCK
            while True:  # the next mark that follows something else
                end = marked.find(SPACE, end)
                if end < 0 or marked[end - 1] != SPACE:
                    break
                end += 1
            if end < 0:
                break
            yield marked[start:end]
            start = end
        yield marked[start:]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of pairs of symbols; rank _NONE where they make no piece."""
        at = self.pairs.find((a.astype(np.int64) << _SHIFT) | b)
        return self.ranks[at], self.merged[at]

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of each word, and the word of each: the merge rounds.

        ``word`` is sorted. Long words are cut first between symbols that stand together in no piece.
        """
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        place = np.arange(len(symbols))
        joined = word[1:] == word[:-1]
        long = np.flatnonzero((np.bincount(word) > LONG)[word[:-1]] & joined) if len(joined) else place[:0]
        if len(long):
            joined[long] = self.together.has((symbols[long].astype(np.int64) << _SHIFT) | symbols[long + 1])
        run = np.r_[0, np.cumsum(~joined)]
        ranks, into = np.full(len(symbols), _NONE, np.int32), np.zeros(len(symbols), np.int32)
        if len(joined):
            found, into[:-1] = self._pairs(symbols[:-1], symbols[1:])
            ranks[:-1] = np.where(joined, found, _NONE)
        while len(symbols):
            new = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            least = np.minimum.reduceat(ranks, new)
            lengths = np.diff(np.r_[new, len(symbols)])
            over = least == _NONE
            if self.last_by_pass:
                for k in np.flatnonzero((least == self.last) & (lengths > 2)):
                    at = slice(new[k], new[k] + lengths[k])
                    done.append(self._pass(symbols[at], word[at], place[at]))
                    over[k] = True
                    symbols[at] = -1
            if over.any():
                gone = np.repeat(over, lengths)
                kept = gone & (symbols >= 0)
                done.append((symbols[kept], word[kept], place[kept]))
                symbols, word, place, ranks, into, run = (v[~gone] for v in (symbols, word, place, ranks, into, run))
                new, least, lengths = None, least[~over], lengths[~over]
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == np.repeat(least, lengths))
            # Of pairs that overlap, every second one from the left; of hasty ranks, a word's first one.
            first = np.r_[True, np.diff(hit) != 1]
            order = np.arange(len(hit))
            take = (order - np.maximum.accumulate(np.where(first, order, 0))) % 2 == 0
            leftmost = np.r_[True, run[hit[1:]] != run[hit[:-1]]]
            hit = hit[take & (leftmost | ~self.hasty[ranks[hit]])]
            symbols[hit] = into[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            left_over = hit - np.arange(len(hit))  # places of the merged symbols after compaction
            symbols, word, place, ranks, into, run = (v[keep] for v in (symbols, word, place, ranks, into, run))
            changed = np.zeros(len(symbols), bool)
            changed[left_over] = True
            changed[:-1] |= changed[1:]
            ranks[changed] = _NONE
            inside = np.flatnonzero(changed[:-1] & (run[1:] == run[:-1]))
            ranks[inside], into[inside] = self._pairs(symbols[inside], symbols[inside + 1])
        if not done:
            return symbols, word
        out, of, places = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(places, kind="stable")
        return out[order], of[order]

    def _pass(self, symbols: np.ndarray, word: np.ndarray, place: np.ndarray):
        """What is left of a word that has pairs of the last rank only, the leftmost merged first: a stack."""
        stack: list[tuple[int, int]] = []
        for s, p in zip(symbols.tolist(), place.tolist(), strict=True):
            stack.append((s, p))
            while len(stack) > 1:
                made = self.last_pairs.get((stack[-2][0] << _SHIFT) | stack[-1][0])
                if made is None:
                    break
                stack[-2:] = [(made, stack[-2][1])]
        out = np.array(stack, np.int64).reshape(-1, 2)
        return out[:, 0].astype(np.int32), word[: len(out)], out[:, 1]

    def encode_words(self, words: list[str]) -> Ragged:
        """Ids of each word."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbols, word = self.merge(self.of_code[codes], word)
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return Ragged(symbols, np.bincount(word, minlength=len(words)))
        # Characters without a piece become the pieces of their bytes.
        spelled = [
            (chr(s - OTHER) if s >= OTHER else self.inner[s - self.size]).encode() for s in symbols[odd].tolist()
        ]
        lengths = np.ones(len(symbols), np.int64)
        lengths[odd] = [len(b) for b in spelled]
        ids = np.repeat(symbols, lengths)
        ids[np.repeat(symbols >= self.size, lengths)] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return Ragged(ids, np.bincount(word, weights=lengths, minlength=len(words)).astype(np.int64))

    def decode_flat(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """UTF-8 text of each list of ids; ids outside the model are refused."""
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= self.size):
            raise ValueError("an id is not in the model")
        text = self.texts.take(ids)
        data, at, out = text.flat.tobytes(), np.r_[0, np.cumsum(text.lengths)], []
        ends = np.cumsum(lengths)
        for start, end in zip((ends - lengths).tolist(), ends.tolist(), strict=True):
            raw = data[at[start] : at[end]]
            own = ids[start:end]
            # The mark before the text goes, from the first piece that is not a control.
            head = np.argmin(self.is_control[own]) if len(own) else 0
            if len(own) and self.spaced[own[head]]:
                raw = raw[1:]
            if self.is_byte[own].any():
                # Characters are put together from bytes that follow each other; a control between them keeps them apart.
                cuts = at[start + np.flatnonzero(self.is_control[own])] - at[end] + len(raw)
                cuts = np.maximum(cuts, 0)  # before the mark
                parts = [raw[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(raw)], strict=True)]
                raw = "".join(p.decode("utf-8", "replace-each") for p in parts).encode()
            out.append(raw)
        return out


def _replace_each(error: UnicodeDecodeError) -> tuple[str, int]:
    """Each byte that is no part of a character is a replacement character, as the library has it."""
    return "\ufffd", error.start + 1


codecs.register_error("replace-each", _replace_each)


class Lookup:
    """Places of distinct keys, found by open addressing; a key that is not there has the place after the last."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys))))) + 2)
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.place = np.full(1 << self.bits, len(keys), np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = left[self.slots[slot[left]] < 0]
            self.slots[slot[free]] = keys[free]  # of several for one slot the last one stays
            here = left[self.slots[slot[left]] == keys[left]]
            self.place[slot[here]] = here
            left = left[self.slots[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        return self.place[self._at(keys)]

    def has(self, keys: np.ndarray) -> np.ndarray:
        return self.slots[self._at(keys)] == keys

    def _at(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        left = np.flatnonzero((self.slots[slot] != keys) & (self.slots[slot] >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
            left = left[(self.slots[slot[left]] != keys[left]) & (self.slots[slot[left]] >= 0)]
        return slot


class Ragged:
    """Lists of numbers in one flat array."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.starts = np.cumsum(lengths) - lengths

    def take(self, at: np.ndarray) -> Ragged:
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        inside = np.arange(total) - np.repeat(ends - lengths, lengths)
        return Ragged(self.flat[np.repeat(self.starts[at], lengths) + inside], lengths)

    def plus(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.flat, other.flat]), np.concatenate([self.lengths, other.lengths]))


class Encoder:
    """Encodes texts and remembers words, forgetting all when they become too many."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = Ragged(np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _encode(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED or len(self.ids.flat) > 16 * REMEMBERED:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            n = len(self.known)
            self.ids = self.ids.plus(self.model.encode_words(new))
            self.known.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text. Short texts share a step; a long one takes several."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        n_waiting = 0

        def flush() -> None:
            nonlocal n_waiting
            at = self._encode([w for _, ws in waiting for w in ws])
            found = self.ids.take(at)
            ends = np.r_[0, np.cumsum(found.lengths)]
            start = 0
            for i, ws in waiting:
                out[i].append(found.flat[ends[start] : ends[start + len(ws)]])
                start += len(ws)
            waiting.clear()
            n_waiting = 0

        for i, text in enumerate(texts):
            for block in self.model.blocks(text) if text else ():
                waiting.append((i, self.model.word.findall(block)))
                n_waiting += len(block)
                if n_waiting >= BLOCK:
                    flush()
        flush()
        return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]


def load(spark: SparkSession, path: str) -> Broadcast:
    """The tables of the model file at ``path`` (on the driver), broadcast. Their size is that of the model."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(Model(file.read()))


def _offsets(lengths) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))


def _encode_batches(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            for part in _small(batch, 1):
                ids = encoder.encode(part.column(1).to_pylist())
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(_offsets([len(x) for x in ids]), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["key", "ids"])
    return run


def _decode_batches(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _small(batch, 1):
                lists = part.column(1)
                lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = model.value.decode_flat(lists.flatten().to_numpy(zero_copy_only=False), lengths)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, pa.array([t.decode() for t in texts], pa.string())], names=["key", "ids", "text"]
                )
    return run


def _small(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` holds about 4 MB."""
    step = max(1, int(batch.num_rows * (1 << 22) / max(1, batch.column(column).nbytes)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def encode(rows: DataFrame, key: str, text: str, model: Broadcast) -> DataFrame:
    """key, ids: the ids of each whole text as the library gives them, without begin or end ids.

    Null and empty texts have no ids; repeated rows and null keys are kept; further columns play no part.
    """
    chosen = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInArrow(_encode_batches(model), f"key {kind}, ids array<int>")


def decode(rows: DataFrame, key: str, ids: str, model: Broadcast) -> DataFrame:
    """key, ids, text: what each list of ids stands for; null and empty lists are empty text, bytes that are no
    character are replacement characters, and an id that the model does not have is an error."""
    chosen = rows.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInArrow(_decode_batches(model), f"key {kind}, ids array<int>, text string")
