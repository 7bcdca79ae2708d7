"""Scoring by a gated recurrent language model with a class-factored output, in numpy.

A token is predicted in two steps: its class, then the word in its class. The most frequent training words
fill WORD_CLASSES classes by frequency. All other words are in one of RARE classes, by a hash of their ending,
and have their add-one share of that class. A token that repeats the one before it is a class of its own. State is
carried from window to window, so that a document counts whole.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import fold_out, ids_and_text, stored

HELD_MOD, HELD_REST = 7, 2
# Words with a count that every task knows; all others are joined.
TOP = 1 << 18
WORD_CLASSES, CLASS_SIZE, RARE = 64, 64, 32
EMBED, STATE = 16, 24
# The model starts on WARM documents in one task; then every task goes on with all documents
# of its own, and the models are averaged.
WARM = 1200
END = b"\n"
_REPEAT = WORD_CLASSES + RARE
_CLASSES = _REPEAT + 1
_MODEL_WORDS = WORD_CLASSES * CLASS_SIZE
_BEGIN = _MODEL_WORDS + RARE
_ENDING = 3
_CHUNK = 1024
# So many rows of logits are worked on at a time.
_ROWS = 1024
# Bytes of text that a task scores at a time.
BLOCK = 1 << 22


def rare_class(word: bytes) -> int:
    return zlib.crc32(word[-_ENDING:]) % RARE


def _rare_classes(found: pa.Array) -> np.ndarray:
    """``rare_class`` of each of ``found``, asked once per ending."""
    endings = pc.binary_slice(found, -_ENDING).dictionary_encode()
    return np.array([rare_class(w) for w in endings.dictionary.to_pylist()], np.int32)[endings.indices.to_numpy()]


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of texts one after the other: the place of each token among the distinct ones, these, and where each text begins.
    Tokens are the words of a text (``common.words``) and one end. Arrow's ASCII white space is that of ``bytes.split``."""
    n, buffers = len(texts), texts.buffers()
    whole = pa.LargeStringArray if pa.types.is_large_binary(texts.type) else pa.StringArray
    lower = pc.ascii_lower(whole.from_buffers(n, buffers[1], buffers[2], offset=texts.offset))
    trimmed = pc.ascii_trim_whitespace(lower)
    split = pc.ascii_split_whitespace(trimmed)
    # A text without words is split into one empty text.
    sizes = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes -= pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    found = split.flatten()
    coded = found.filter(pc.not_equal(pc.binary_length(found), 0)).dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary() if whole is pa.StringArray else pa.large_binary()).cast(pa.binary())
    ends = np.cumsum(sizes + 1) - 1
    codes = np.empty(int(sizes.sum()) + n, np.int32)
    inside = np.ones(len(codes), bool)
    inside[ends] = False
    codes[inside], codes[ends] = coded.indices.to_numpy(), len(distinct)
    return codes, pa.concat_arrays([distinct, pa.array([END], pa.binary())]), ends - sizes


class Network:
    """Parameters, forward and backward steps over windows (time x streams)."""

    SHAPES = {
        "embed": (_BEGIN + 1, EMBED), "enter": (EMBED, 3 * STATE), "again": (STATE, 3 * STATE), "bias": (3 * STATE,),
        "to_class": (STATE, _CLASSES), "class_bias": (_CLASSES,), "to_word": (_MODEL_WORDS, STATE), "word_bias": (_MODEL_WORDS,),
    }

    def __init__(self, flat: np.ndarray | None = None, seed: int = 1):
        sizes = [int(np.prod(s)) for s in self.SHAPES.values()]
        if flat is None:
            flat = np.random.default_rng(seed).normal(0, 0.1, sum(sizes)).astype(np.float32)
        self.flat, at = flat, 0
        for (name, shape), size in zip(self.SHAPES.items(), sizes):
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size
        self._bounded: bool | None = None
        self._rooms: dict[tuple, np.ndarray] = {}

    def _room(self, name: str, shape: tuple, dtype=np.float32) -> np.ndarray:
        """An array of any content, the same memory at every call: new memory costs a page fault for every 4 KB."""
        size, held = int(np.prod(shape)), self._rooms.get((name, dtype))
        if held is None or len(held) < size:
            held = self._rooms[name, dtype] = np.empty(size, dtype)
        return held[:size].reshape(shape)

    def entered(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of tokens: time x gates x streams, so that each gate is one run of memory. They hold until the next call."""
        out = self._room("entered", (len(x), 3 * STATE, x.shape[1]), self.embed.dtype)
        np.matmul(self.enter.T, self.embed[x].transpose(0, 2, 1), out=out)
        out += self.bias[:, None]
        return out

    def run(self, gates: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        out = np.empty((len(gates), *h.shape), np.float32)
        again, h = np.ascontiguousarray(self.again.T), np.ascontiguousarray(h.T)
        for t, g in enumerate(gates):
            a = again @ h
            u = a[2 * STATE :]
            zr = a[: 2 * STATE] + g[: 2 * STATE]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:STATE], zr[STATE:]
            n = r * u
            n += g[2 * STATE :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((h, z, r, n, u))
            h = h - n
            h *= z
            h += n
            out[t] = h.T
        return out

    def bounded(self, anew: bool = False) -> bool:
        """True if no logit can overflow: states lie within -1 and 1. Asked once, when the model is only read, or ``anew``."""
        if self._bounded is None or anew:
            most = np.abs(self.to_class).sum(axis=0) + np.abs(self.class_bias)
            words = np.abs(self.to_word) @ np.ones(STATE, self.to_word.dtype) + np.abs(self.word_bias)
            self._bounded = bool(max(most.max(), words.max()) < 60)
        return self._bounded

    def nll(self, states: np.ndarray, cls: np.ndarray, word: np.ndarray, slopes: dict | None = None):
        """Minus log of the probability of each target (natural); with ``slopes`` also the gradient by state.

        ``word`` is -1 where the class is all that there is to predict. Targets are sorted by class once, so that a class
        costs one product; the rest is done for some rows together, as many as a core's cache takes."""
        plain = self.bounded(anew=slopes is not None)

        def picked(logits: np.ndarray, pick: np.ndarray) -> np.ndarray:
            """Minus log of the softmax at ``pick``; ``logits`` become the gradient if that is asked for."""
            rows = np.arange(len(pick))
            if not plain:
                logits -= logits.max(axis=1, keepdims=True)
            chosen = logits[rows, pick]
            p = np.exp(logits, out=logits)
            total = p @ np.ones(p.shape[1], p.dtype)
            if slopes is not None:
                p *= (1 / total)[:, None]
                p[rows, pick] -= 1
            return np.log(total) - chosen

        dtype = np.result_type(states, self.to_class)
        # Biases are weights of a state that is always 1.
        by_class = np.vstack([self.to_class, self.class_bias])
        by_word = np.hstack([self.to_word, self.word_bias[:, None]])
        bare, states = states, self._room("states", (len(states), STATE + 1), states.dtype)
        states[:, :STATE], states[:, STATE] = bare, 1
        out = np.empty(len(states), dtype)
        if slopes is not None:
            back = np.empty((len(states), STATE), dtype)
            of_class, of_word = np.zeros_like(by_class), np.zeros_like(by_word)
        for i in range(0, len(states), _ROWS):
            at = slice(i, i + _ROWS)
            p = np.matmul(states[at], by_class, out=self._room("classes", (len(states[at]), _CLASSES), dtype))
            out[at] = picked(p, cls[at])
            if slopes is not None:
                of_class += states[at].T @ p
                back[at] = p @ self.to_class.T
        inside = np.flatnonzero(word >= 0)
        inside = inside[np.argsort(cls[inside].astype(np.int16), kind="stable")]
        of, own = cls[inside], states[inside]
        pick = word[inside] - of * CLASS_SIZE
        cuts = np.searchsorted(of, np.arange(WORD_CLASSES + 1)).tolist()
        loss, own_back = np.empty(len(inside), dtype), np.empty((len(inside) if slopes is not None else 0, STATE), dtype)
        low = 0
        while low < WORD_CLASSES:
            high = low + 1
            while high < WORD_CLASSES and cuts[high] - cuts[low] < _ROWS:
                high += 1
            begin = cuts[low]
            spans = [
                (slice(cuts[c] - begin, cuts[c + 1] - begin), slice(c * CLASS_SIZE, (c + 1) * CLASS_SIZE))
                for c in range(low, high) if cuts[c] < cuts[c + 1]
            ]
            all_ = slice(begin, cuts[high])
            p, rows = self._room("words", (cuts[high] - begin, CLASS_SIZE), dtype), own[all_]
            for at, span in spans:
                np.matmul(rows[at], by_word[span].T, out=p[at])
            loss[all_] = picked(p, pick[all_])
            if slopes is not None:
                to = own_back[all_]
                for at, span in spans:
                    np.matmul(p[at].T, rows[at], out=of_word[span])
                    np.matmul(p[at], self.to_word[span], out=to[at])
            low = high
        out[inside] += loss
        if slopes is None:
            return out
        back[inside] += own_back
        slopes["to_class"], slopes["class_bias"] = of_class[:STATE], of_class[STATE]
        slopes["to_word"], slopes["word_bias"] = of_word[:, :STATE], of_word[:, STATE]
        return out, back

    def gradient(self, x: np.ndarray, cls: np.ndarray, word: np.ndarray, valid: np.ndarray, h: np.ndarray):
        """Loss per token, state after the window and the flat gradient; nothing flows back beyond the window."""
        t, b = x.shape
        keep: list = []
        states = self.run(self.entered(x), h, keep)
        on = valid.ravel()
        n_on = max(1, int(on.sum()))
        slopes: dict = {}
        loss, back = self.nll(states.reshape(-1, STATE)[on], cls.ravel()[on], word.ravel()[on], slopes)
        d_state = np.zeros((t * b, STATE), np.float32)
        d_state[on] = back / n_on
        for name in ("to_class", "class_bias", "to_word", "word_bias"):
            slopes[name] /= n_on
        d_state = np.ascontiguousarray(d_state.reshape(t, b, STATE).transpose(0, 2, 1))
        d_gate = self._room("gates", (3 * STATE, t, b))
        d_again = np.zeros_like(self.again)
        d, d_a = np.zeros((STATE, b), np.float32), np.empty((3 * STATE, b), np.float32)
        for i in range(t - 1, -1, -1):
            before, z, r, n, u = keep[i]
            d += d_state[i]
            rest = d * (1 - z)
            d_n = rest * (1 - n * n)
            rest *= z
            rest *= before - n
            d_a[:STATE] = rest
            d_r = d_n * r
            d_a[2 * STATE :] = d_r
            d_r *= 1 - r
            d_r *= u
            d_a[STATE : 2 * STATE] = d_r
            d_gate[: 2 * STATE, i], d_gate[2 * STATE :, i] = d_a[: 2 * STATE], d_n
            d_again += before @ d_a.T
            d *= z
            d += self.again @ d_a
        gate = d_gate.reshape(3 * STATE, -1)
        slopes["again"], slopes["bias"] = d_again, gate.sum(axis=1)
        slopes["enter"] = self.embed[x].reshape(-1, EMBED).T @ gate.T
        slopes["embed"] = np.zeros_like(self.embed)
        order = np.argsort(x.ravel().astype(np.int16), kind="stable")
        seen = x.ravel()[order]
        first = np.flatnonzero(np.r_[True, seen[1:] != seen[:-1]])
        slopes["embed"][seen[first]] = np.add.reduceat((gate.T @ self.enter.T)[order], first)
        return float(loss.mean()) if len(loss) else 0.0, states[-1], np.concatenate([slopes[n].ravel() for n in self.SHAPES])


class Vocabulary:
    """The TOP words with their training counts, the model's words first; all tasks get it."""

    def __init__(self, known: list[bytes], counts: np.ndarray, n: int, distinct: int, rare_n: np.ndarray, rare_v: np.ndarray):
        self.known, self.counts, self.n, self.distinct = known, counts, n, distinct
        self.rare_log = np.log10(rare_n + rare_v + 1.0)
        self._find: pa.Array | None = None

    def encode(self, texts: pa.Array):
        """Of the texts' tokens one after the other: place among the distinct ones, input, class and word to predict, and
        whether each repeats the one before it; of the distinct tokens: bytes, place among the known (or -1) and rare
        class; and where each text begins."""
        if self._find is None:
            self._find = pa.array(self.known, pa.binary())
        codes, distinct, starts = _tokens(texts)
        at = pc.fill_null(pc.index_in(distinct, value_set=self._find), -1).to_numpy().astype(np.int64)
        rare = _rare_classes(distinct)
        again = np.zeros(len(codes), bool)
        again[1:] = codes[1:] == codes[:-1]
        again[starts] = False
        model = (at >= 0) & (at < _MODEL_WORDS)
        own = np.where(model, at, _MODEL_WORDS + rare).astype(np.int32)
        x = np.empty(len(codes), np.int32)
        x[1:] = own[codes[:-1]]
        x[starts] = _BEGIN
        cls = np.where(model, at // CLASS_SIZE, WORD_CLASSES + rare).astype(np.int32)[codes]
        cls[again] = _REPEAT
        word = np.where(model, at, -1).astype(np.int32)[codes]
        word[again] = -1
        return codes, x, cls, word, again, distinct, at, rare, starts


def _windows(docs: Iterator[tuple], streams: int, length: int) -> Iterator[tuple]:
    """(slots, fresh, x, cls, word, valid): windows over up to ``streams`` documents side by side.
    A slot takes the next document when its own has ended; ``fresh`` slots begin with an empty state."""
    slots: list[list | None] = [None] * streams  # document, next position, its x, cls and word
    done = False
    while True:
        fresh = []
        for i, slot in enumerate(slots):
            if slot is not None and slot[1] < len(slot[0][1]) or done:
                if slot is not None and slot[1] >= len(slot[0][1]):
                    slots[i] = None
                continue
            item = next(docs, None)
            done = item is None
            slots[i] = None if done else [item, 0, np.stack(item[1:], dtype=np.int32, casting="unsafe")]
            if not done:
                fresh.append(i)
        busy = [i for i, s in enumerate(slots) if s is not None]
        if not busy:
            return
        longest = min(length, max(len(slots[i][0][1]) - slots[i][1] for i in busy))
        held, ends = np.zeros((3, longest, len(busy)), np.int32), np.empty(len(busy), np.int64)
        held[2] = -1
        for j, i in enumerate(busy):
            _, at, own = slots[i]
            n = ends[j] = min(longest, own.shape[1] - at)
            held[:, :n, j] = own[:, at : at + n]
            slots[i][1] = at + n
        x, cls, word = held
        valid = np.arange(longest)[:, None] < ends
        yield [(i, slots[i][0][0], slots[i][1] >= len(slots[i][0][1])) for i in busy], fresh, x, cls, word, valid


def _train(network: Network, docs: Iterator[tuple], rate: float, passes: int = 1, streams: int = 48) -> int:
    """Adam over windows of 20 tokens, with smaller steps where few documents are left. Returns the tokens seen."""
    first, second, spare = np.zeros_like(network.flat), np.zeros_like(network.flat), np.empty_like(network.flat)
    step = tokens = 0
    held = list(docs) if passes > 1 else None
    for _ in range(passes):
        state = np.zeros((streams, STATE), np.float32)
        for slots, fresh, x, cls, word, valid in _windows(iter(held) if held is not None else docs, streams, 20):
            state[fresh] = 0
            at = [i for i, _, _ in slots]
            _, state[at], slope = network.gradient(x, cls, word, valid, state[at])
            slope *= min(1.0, 5.0 / (float(np.sqrt(slope @ slope)) + 1e-9))
            step += 1
            n = int(valid.sum())
            tokens += n
            scale = float(rate * np.sqrt(n / (20 * streams) * (1 - 0.998**step)) / (1 - 0.9**step))
            # In place, in one scratch array: first += 0.1 (slope - first), second += 0.002 (slope^2 - second).
            np.subtract(slope, first, out=spare)
            spare *= 0.1
            first += spare
            slope *= slope
            slope -= second
            slope *= 0.002
            second += slope
            np.sqrt(second, out=spare)
            spare += 1e-7
            np.divide(first, spare, out=spare)
            spare *= scale
            network.flat -= spare
    return tokens


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple]:
    for batch in batches:
        texts = batch.column("text")
        for rows in _cut(_sizes(texts)):
            _, x, cls, word, _, _, _, _, starts = vocabulary.encode(texts.slice(rows.start, len(rows)))
            bounds = [*starts.tolist(), len(x)]
            for low, high in zip(bounds, bounds[1:]):
                yield None, x[low:high], cls[low:high], word[low:high]


def _learner(vocabulary: Broadcast, start: Broadcast | None, rate: float, passes: int, streams: int):
    """Trains over a task's documents and gives the parameters in pieces, times the tokens."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(start.value.copy() if start else None)
        tokens = _train(network, _encoded(batches, vocabulary.value), rate, passes, streams)
        if tokens:
            pieces = [network.flat[i : i + _CHUNK].astype("<f4").tobytes() for i in range(0, len(network.flat), _CHUNK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(pieces)), pa.int32()), pa.array([float(tokens)] * len(pieces)), pa.array(pieces, pa.binary())],
                ["piece", "tokens", "values"],
            )

    return learn


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token-weighted means of the pieces that meet in this task, one sum per piece."""
    sums: dict[int, list] = {}
    for batch in batches:
        for piece, tokens, values in zip(*(batch.column(c).to_pylist() for c in ("piece", "tokens", "values"))):
            held = sums.setdefault(piece, [0.0, 0.0])
            held[0] += tokens
            held[1] = held[1] + tokens * np.frombuffer(values, "<f4").astype(np.float64)
    values = [(s / n).astype("<f4").tobytes() for n, s in sums.values()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(sums.keys(), pa.int32()), pa.array([n for n, _ in sums.values()], pa.float64()), pa.array(values, pa.binary())],
        ["piece", "tokens", "values"],
    )


_PIECES = "piece int, tokens double, values binary"


def _together(pieces: DataFrame) -> np.ndarray | None:
    """The averaged model; only that reaches the driver. None if nothing was trained."""
    found = pieces.repartition("piece").mapInArrow(_mean, _PIECES).toArrow().sort_by("piece")
    if not len(found):
        return None
    return np.concatenate([np.frombuffer(v, "<f4") for v in found.column("values").to_pylist()]).astype(np.float32)


def train(docs: DataFrame, vocabulary: Broadcast, warm: int = WARM) -> Broadcast:
    """The network's parameters, from ``docs(doc_id, text)``, all of which may be learnt from.

    It starts on the ``warm`` documents whose ids hash lowest. After that each task trains
    on all of its documents, and the results are averaged.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.lit(1), "doc_id")
    ids = docs.select("doc_id").distinct().orderBy(order, "doc_id").limit(warm)
    first = docs.join(F.broadcast(ids), "doc_id").select("text").repartition(1)
    start = _together(first.mapInArrow(_learner(vocabulary, None, 0.01, 2, 48), _PIECES))
    start = Network().flat if start is None else start
    learner = _learner(vocabulary, spark.sparkContext.broadcast(start), 0.005, 1, 256)
    all_ = _together(docs.select("text").mapInArrow(learner, _PIECES))
    return spark.sparkContext.broadcast(start if all_ is None else all_)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a task, apart for learning and held-out rows, folded when many words are held."""
    kept: list[pa.Table] = []

    def folded() -> pa.Table:
        return pa.concat_tables(kept).group_by(["word", "held"]).aggregate([("n", "sum")]).rename_columns(["word", "held", "n"])

    for batch in batches:
        texts = batch.column("text")
        held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(np.int64)
        for rows in _cut(_sizes(texts)):
            codes, distinct, starts = _tokens(texts.slice(rows.start, len(rows)))
            of = np.repeat(held[rows.start : rows.stop], np.diff(np.r_[starts, len(codes)]))
            n = np.bincount(codes * 2 + of, minlength=2 * len(distinct))
            for mark in (0, 1):
                some = np.flatnonzero(n[mark::2])
                its = [distinct.take(pa.array(some)), pa.array(np.full(len(some), mark, np.int32)), pa.array(n[mark::2][some])]
                kept.append(pa.table(its, names=["word", "held", "n"]))
            if sum(map(len, kept)) > 500_000:
                kept[:] = [folded()]
                if len(kept[0]) > 250_000:
                    yield from kept.pop().to_batches()
    if kept:
        yield from folded().to_batches()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c (in learning rows), a (in all rows) of ``docs(text, held_out)``; an end per row."""
    rows = docs.select("held_out", "text").mapInArrow(_count, "word binary, held int, n long")
    c = F.sum(F.when(F.col("held") == 0, F.col("n")).otherwise(0)).alias("c")
    return stored(rows.groupBy("word").agg(c, F.sum("n").alias("a")), "words")


def vocabulary(counts: DataFrame, top: int = TOP) -> Broadcast:
    """The most frequent words (at most ``top``, by steps of frequency) with the sums over all words."""
    level = F.floor(F.log2(F.col("a")) * 8).alias("level")
    room, lowest = top, None
    for r in sorted(counts.groupBy(level).count().collect(), key=lambda r: -r.level):
        room -= r["count"]
        if room < 0:
            break
        lowest = r.level
    chosen = counts.filter(level >= (lowest if lowest is not None else 1 << 30)).toArrow()
    c = dict(zip(chosen.column("word").to_pylist(), chosen.column("c").to_pylist()))
    end = c.pop(END, None)
    if end is None:
        found = counts.filter(F.col("word") == F.lit(END)).first()
        end = found.c if found else 0
    ranked = sorted(c, key=lambda w: (-c[w], w))
    seen = counts.filter("c > 0")
    total = seen.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    model_words = [END, *(w for w in ranked[: _MODEL_WORDS - 1] if c[w] > 0)]
    cls = F.crc32(F.when(F.octet_length("word") <= _ENDING, F.col("word")).otherwise(F.substring("word", -_ENDING, _ENDING))) % RARE
    n, v = np.zeros(RARE), np.zeros(RARE)
    for r in seen.groupBy(cls.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        n[r.k], v[r.k] = r.n, r.v
    for w in model_words:
        count = end if w == END else c[w]
        if count > 0:
            n[rare_class(w)] -= count
            v[rare_class(w)] -= 1
    # Places of the model's words that are not needed stay empty, so that ids below _MODEL_WORDS are its words.
    known = model_words + [b" "] * (_MODEL_WORDS - len(model_words)) + ranked[len(model_words) - 1 :]
    counted = np.array([end if w == END else c.get(w, 0) for w in known], np.int64)
    return counts.sparkSession.sparkContext.broadcast(Vocabulary(known, counted, total.n, total.v, n, v))


def _cut(sizes: np.ndarray) -> Iterator[range]:
    """Rows of blocks of BLOCK bytes of text, or one row."""
    block = np.cumsum(sizes) // BLOCK
    bounds = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(sizes)]
    return (range(a, b) for a, b in zip(bounds, bounds[1:]) if a < b)


def _sizes(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[list, list, pa.Array]]:
    """Ids, marks and texts of a batch in blocks. The longest texts of the batch come first: it
    is read by many streams side by side, and the last ones then end at about the same time."""
    sizes = _sizes(batch.column("text"))
    order = np.argsort(-sizes, kind="stable")
    for rows in _cut(sizes[order]):
        part = batch.take(pa.array(order[rows.start : rows.stop]))
        yield part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), part.column("text")


def _scorer(vocabulary: Broadcast, parameters: Broadcast):
    """Per row: tokens, what the known words give, and the words whose counts are to be joined."""
    log_e = np.log(10.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, network = vocabulary.value, Network(parameters.value)
        log_count = np.log10(vocab.counts + 1.0)
        out_of = float(np.log10(vocab.n + vocab.distinct + 1.0))
        ready: deque = deque()

        def docs() -> Iterator[tuple]:
            for batch in batches:
                for ids, held, texts in _blocks(batch):
                    yield from encoded(ids, held, texts)

        def encoded(ids: list, held: list, texts: pa.Array) -> Iterator[tuple]:
            codes, x, cls, word, again, distinct, at, rare, starts = vocab.encode(texts)
            lengths = np.diff(np.r_[starts, len(codes)])
            known = at >= 0
            counted = np.where(known, log_count[at], 0.0)
            part = np.where(at >= _MODEL_WORDS, counted, 0.0) - np.where((at >= 0) & (at < _MODEL_WORDS), 0.0, vocab.rare_log[rare])
            base = np.add.reduceat(counted[codes], starts) - out_of * lengths
            part = np.add.reduceat(np.where(again, 0.0, part[codes]), starts)
            n_known = np.add.reduceat((known & (vocab.counts[at] > 0))[codes], starts, dtype=np.int64)
            # Words whose counts are to be joined: one entry for each in a text, with how often it is there.
            unknown = np.flatnonzero(~known[codes])
            doc = np.searchsorted(starts, unknown, side="right") - 1
            pairs, of = np.unique(doc * len(distinct) + codes[unknown], return_inverse=True)
            found = distinct.take(pa.array(pairs % len(distinct))).to_pylist()
            ns = np.bincount(of, minlength=len(pairs)).tolist()
            fresh = np.bincount(of, weights=~again[unknown], minlength=len(pairs)).astype(np.int64).tolist()
            cuts = np.searchsorted(pairs, np.arange(len(starts) + 1) * len(distinct)).tolist()
            rows = zip(ids, held, lengths.tolist(), n_known.tolist(), base.tolist(), part.tolist(), strict=True)
            for i, (row, start, size) in enumerate(zip(rows, starts.tolist(), lengths.tolist(), strict=True)):
                its, own = slice(cuts[i], cuts[i + 1]), slice(start, start + size)
                yield [*row, found[its], ns[its], fresh[its]], x[own], cls[own], word[own]

        def out() -> pa.RecordBatch:
            rows = [ready.popleft() for _ in range(len(ready))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCORED.types)], schema=_SCORED)

        state = np.zeros((512, STATE), np.float32)
        for slots, fresh, x, cls, word, valid in _windows(docs(), 512, 48):
            state[fresh] = 0
            at = [i for i, _, _ in slots]
            states = network.run(network.entered(x), state[at])
            state[at] = states[-1]
            loss = np.zeros(valid.shape)
            loss[valid] = network.nll(states[valid], cls[valid], word[valid])
            for (_, row, ended), nats in zip(slots, loss.sum(axis=0).tolist()):
                row[5] -= nats / log_e
                if ended:
                    ready.append(row)
            if len(ready) >= 1000:
                yield out()
        if ready:
            yield out()

    return score


_SCORED = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base", pa.float64()), ("part", pa.float64()), ("words", pa.list_(pa.binary())), ("ns", pa.list_(pa.int32())),
    ("fresh", pa.list_(pa.int32())),
])
_SCORED_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, part double, words array<binary>, ns array<int>, fresh array<int>"


def score(docs: DataFrame, warm: int = WARM) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of
    ``docs(doc_id, text)``, both scores in log10.

    Counts cover all learning rows. What every task knows is bounded (TOP words); the other words of a document
    meet their counts in a join, in which no word is frequent. Null and empty texts are the end alone.
    Repeated rows count as often as they are there. With nothing to learn from, every count is 0.
    """
    rows = ids_and_text(docs).withColumn("held_out", fold_out("doc_id", HELD_MOD, HELD_REST))
    counts = word_counts(rows)
    vocab = vocabulary(counts)
    parameters = train(rows.filter(~F.col("held_out")).select("doc_id", "text"), vocab, warm)
    seen = rows.mapInArrow(_scorer(vocab, parameters), _SCORED_SQL)
    seen = stored(seen.select(F.monotonically_increasing_id().alias("row"), "*"), "scored")
    each = seen.select("row", F.explode(F.arrays_zip("words", "ns", "fresh")).alias("w"))
    each = each.select("row", F.col("w.words").alias("word"), F.col("w.ns").alias("n"), F.col("w.fresh").alias("fresh"))
    each = each.join(counts.filter("c > 0").select("word", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log = F.log10(F.col("c") + 1.0)
    met = each.select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"),
        F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("n").cast("long")).otherwise(0).alias("n_known"),
        (log * F.col("n")).alias("base"), (log * F.col("fresh")).alias("part"),
    )
    parts = seen.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "part").unionByName(met)
    total = parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"),
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "part")],
    )
    return total.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(vocab.value.n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), F.col("part").alias("score"),
    )
