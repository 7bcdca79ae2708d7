"""Personal data: patterns, and a skip-chain conditional random field that adds what they miss.

The nodes of the field are a document's words with a digit or an @; other words cannot be
part of an entity and are fixed to "no entity", so the chain falls apart at them. Neighbouring
nodes share a potential, and so do repeated or similar words at any distance (each with the next one of its
kind, so that links grow with the words and not with their pairs). Beliefs come from loopy message
passing over all documents of a batch at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# Spans that only the field finds have kinds of their own.
LIKE = tuple(f"like_{k}" for k in KINDS)
# Documents that the field is fitted on.
SAMPLE = 3000
SURE = 0.8
ROUNDS = 8
_LABELS = len(KINDS) + 1
_NEXT, _SAME = 0, 1

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ACTIVE = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_EDGE = "\"'.,;:!?()[]{}<>=*#"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > done and text[low - 1] in _LOCAL:
            low -= 1
        found = _DOMAIN.match(text, at + 1) if low < at else None
        if found:
            yield low, (done := found.end())
        at = text.find("@", max(done, at + 1))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) by kind and start, in code points; leftmost and not
    overlapping within a kind. A match that fails its test is dropped whole."""
    if not _ACTIVE.search(text):
        return []
    out = [(0, *s) for s in _emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


# The features of a word ---------------------------------------------------------------

_DIGIT_BINS = (1, 2, 3, 4, 5, 7, 9, 13, 16, 20)
_LENGTH_BINS = (4, 7, 11, 17, 21)
FEATURES = 46


def _features(word: str, before: str | None, after: str | None) -> list[int]:
    """Positions of the features that are on. ``before`` and ``after`` are the active neighbours."""
    core = word.strip(_EDGE)
    digits = _NOT_DIGIT.sub("", word)
    letters = sum(map(str.isalpha, core))
    groups = len(_NOT_DIGIT.sub(" ", word).split())
    parts = core.split(".")
    on = [0, 1 + sum(len(digits) >= b for b in _DIGIT_BINS), 12 + sum(len(core) >= b for b in _LENGTH_BINS)]
    on.append(18 + min(4, len(parts) - 1))
    on.append(23 + min(3, groups))
    on.append(27 + (letters > 0) + (letters > 2))
    flags = (
        "@" in core, "@" in core and "." in core.partition("@")[2], word.startswith("+"), "(" in word, ")" in word,
        "-" in core, "=" in word, '"' in word, core.isdigit(), before is not None, after is not None,
        before is not None and before.startswith("+"), before is not None and ")" in before,
        len(parts) == 4 and all(p.isdigit() and _small(p) for p in parts),
        16 <= len(digits) <= 19 and _luhn(digits), after is not None and "-" in after,
    )
    on += [30 + i for i, f in enumerate(flags) if f]
    return on


def _alike(word: str) -> str | None:
    """Words with the same value are linked: the last seven digits, or the name before an @."""
    name, sign, _ = word.strip(_EDGE).lower().partition("@")
    if sign:
        return f"@{name}" if len(name) > 3 else None
    digits = _NOT_DIGIT.sub("", word)
    return digits[-7:] if len(digits) >= 6 else None


class Graph:
    """The nodes and links of some documents."""

    def __init__(self, texts: list[str]):
        self.spans: list[tuple[int, int]] = []
        self.doc: list[int] = []
        self.index: list[int] = []
        self.on: list[list[int]] = []
        self.label: list[int] = []
        links: list[tuple[int, int, int]] = []
        self.base = [base_spans(t) for t in texts]
        for d, text in enumerate(texts):
            if not _ACTIVE.search(text):
                continue
            nodes = [(i, m) for i, m in enumerate(_WORD.finditer(text)) if _ACTIVE.search(m[0])]
            spans = sorted(((s, e, k) for k, s, e in self.base[d]))
            seen: dict[str, int] = {}
            for j, (i, m) in enumerate(nodes):
                me = len(self.spans)
                near = lambda k, step: nodes[k][1][0] if 0 <= k < len(nodes) and nodes[k][0] == i + step else None  # noqa: E731, B023
                before, after = near(j - 1, -1), near(j + 1, 1)
                if before is not None:
                    links.append((me - 1, me, _NEXT))
                key = _alike(m[0])
                if key is not None:
                    if key in seen:
                        links.append((seen[key], me, _SAME))
                    seen[key] = me
                while spans and spans[0][1] <= m.start():
                    spans.pop(0)
                self.label.append(next((1 + k for s, e, k in spans[:4] if s < m.end() and e > m.start()), 0))
                self.spans.append(m.span())
                self.doc.append(d)
                self.index.append(i)
                self.on.append(_features(m[0], before, after))
        self.links = np.array(links, np.int64).reshape(-1, 3)

    def inputs(self) -> np.ndarray:
        return _inputs(self.on)


def _inputs(on: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(on), FEATURES))
    for i, positions in enumerate(on):
        x[i, positions] = 1
    return x


class Field:
    """Potentials of single words (features x labels) and of the two kinds of links."""

    def __init__(self, single: np.ndarray, pair: np.ndarray):
        self.single, self.pair = single, pair

    def beliefs(self, x: np.ndarray, links: np.ndarray, rounds: int = ROUNDS):
        """Of the nodes, and of the links (given the labels of both ends)."""
        own = x @ self.single
        a, b, kind = links.T
        p = self.pair[kind]
        to_b = np.zeros((len(links), _LABELS))
        to_a = to_b.copy()
        total = own.copy()
        log_sum = lambda v, axis: np.log(np.exp(v - v.max(axis=axis, keepdims=True)).sum(axis=axis)) + v.max(axis=axis)
        for _ in range(rounds if len(links) else 0):
            from_a, from_b = total[a] - to_a, total[b] - to_b
            new_b = log_sum(from_a[:, :, None] + p, 1)
            new_a = log_sum(from_b[:, None, :] + p, 2)
            to_b = 0.5 * to_b + 0.5 * (new_b - new_b.mean(axis=1, keepdims=True))
            to_a = 0.5 * to_a + 0.5 * (new_a - new_a.mean(axis=1, keepdims=True))
            total = own.copy()
            np.add.at(total, b, to_b)
            np.add.at(total, a, to_a)
        node = np.exp(total - total.max(axis=1, keepdims=True))
        node /= node.sum(axis=1, keepdims=True)
        joint = (total[a] - to_a)[:, :, None] + (total[b] - to_b)[:, None, :] + p
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        return node, joint / joint.sum(axis=(1, 2), keepdims=True)


def fit(texts: list[str], **settings: float) -> Field:
    graph = Graph(texts)
    return fit_words(graph.on, graph.label, graph.links, **settings)


def fit_words(
    on: list[list[int]], label: list[int], links: np.ndarray,
    steps: int = 120, rate: float = 0.15, decay: float = 1e-3, blank: float = 0.25,
) -> Field:
    """Fits the field to the patterns' own findings: the gradient is what is seen less what the
    beliefs expect. In each step a part ``blank`` of the words shows no features, so that links
    learn to stand in for them. Without any nodes the field is empty and adds nothing."""
    x, y = _inputs(on), np.eye(_LABELS)[np.array(label, np.int64)]
    field = Field(np.zeros((FEATURES, _LABELS)), np.zeros((2, _LABELS, _LABELS)))
    if not len(x):
        field.single[0, 0] = 9.0
        return field
    seen = np.zeros_like(field.pair)
    np.add.at(seen, (links[:, 2], y[links[:, 0]].argmax(1), y[links[:, 1]].argmax(1)), 1)
    speed = [np.full(field.single.shape, 1e-6), np.full(field.pair.shape, 1e-6)]
    rng = np.random.default_rng(5)
    for _ in range(steps):
        shown = x * (rng.random((len(x), 1)) >= blank)
        shown[:, 0] = 1
        node, joint = field.beliefs(shown, links, 4)
        expected = np.zeros_like(field.pair)
        np.add.at(expected, links[:, 2], joint)
        up = (shown.T @ (y - node) / len(x) - decay * field.single, (seen - expected) / len(x) - decay * field.pair)
        for value, g, s in zip((field.single, field.pair), up, speed):
            s += g * g
            value += rate * g / np.sqrt(s)
    return field


def _all_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """Per text the patterns' spans and the field's, whose kinds follow; by kind and start."""
    graph = Graph(texts)
    out = [list(b) for b in graph.base]
    if graph.spans:
        node, _ = field.beliefs(graph.inputs(), graph.links)
        best = node.argmax(axis=1)
        best[node.max(axis=1) < SURE] = 0
        run: list[int] = []
        for i in range(len(best) + 1):
            more = i < len(best) and best[i] and not graph.label[i]
            joins = more and run and graph.doc[run[-1]] == graph.doc[i] and graph.index[run[-1]] + 1 == graph.index[i]
            if run and not (joins and best[run[-1]] == best[i]):
                d = graph.doc[run[0]]
                low, high = graph.spans[run[0]][0], graph.spans[run[-1]][1]
                cut = texts[d][low:high]
                low, high = low + len(cut) - len(cut.lstrip(_EDGE)), high - len(cut) + len(cut.rstrip(_EDGE))
                if low < high:
                    out[d].append((len(KINDS) + int(best[run[0]]) - 1, low, high))
                run = []
            if more:
                run.append(i)
    return [sorted(s) for s in out]


def learn(docs: DataFrame, sample: int = SAMPLE) -> Broadcast:
    """The field, fitted on the ``sample`` documents with a digit or @ whose ids hash lowest. Their words
    become features where the documents are; the driver gets those and no text."""
    ids = docs.filter(F.col("text").rlike("[0-9@]")).select("doc_id").distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text")
    )

    @F.pandas_udf("on array<array<int>>, label array<int>, links array<array<int>>")
    def graphs(texts: pd.Series) -> pd.DataFrame:
        made = [Graph([t]) for t in texts]
        return pd.DataFrame({
            "on": [g.on for g in made], "label": [g.label for g in made], "links": [g.links.tolist() for g in made],
        })

    on: list[list[int]] = []
    label: list[int] = []
    links: list[np.ndarray] = []
    for r in rows.select("doc_id", graphs("text").alias("g")).orderBy("doc_id").toLocalIterator():
        own = np.array(r.g.links, np.int64).reshape(-1, 3)
        links.append(own + np.array([len(on), len(on), 0]))
        on += r.g.on
        label += r.g.label
    field = fit_words(on, label, np.concatenate([np.zeros((0, 3), np.int64), *links]))
    return docs.sparkSession.sparkContext.broadcast(field)


def spans_column(text: str, field: Broadcast) -> Column:
    """array<struct<kind, start, end>> of a text, null: empty. Kinds in the order of KINDS, then LIKE."""
    names = KINDS + LIKE

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for low in range(0, len(texts), 500):
                part = ["" if t is None else t for t in texts.iloc[low : low + 500]]
                out += _all_spans(part, field.value)
            yield pd.Series([[{"kind": names[k], "start": s, "end": e} for k, s, e in d] for d in out])

    return find(F.col(text))


def redacted(text: str, field: Broadcast) -> Column:
    """The text with each span replaced by its kind in square brackets; overlapping spans are one,
    under the first one's name. A null text stays null."""
    names = KINDS * 2

    @F.pandas_udf("string")
    def cover(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for low in range(0, len(texts), 500):
                part = list(texts.iloc[low : low + 500])
                for t, spans in zip(part, _all_spans(["" if t is None else t for t in part], field.value)):
                    pieces, done = [], 0
                    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
                        if start >= done:
                            pieces += [t[done:start], f"[{names[kind].upper()}]"]
                        done = max(done, end)
                    out.append(t if not pieces else "".join(pieces) + t[done:])
            yield pd.Series(out)

    return cover(F.col(text))


def personal_data(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, spans: one row per row of ``docs(doc_id, text)``; null and empty texts have none.

    Offsets are code points, ends exclusive. Repeated rows give repeated results.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.select("doc_id", spans_column("text", learn(docs, sample)).alias("spans"))
