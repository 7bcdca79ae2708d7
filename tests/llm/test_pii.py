import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatwise.llm import pii
from tests.llm.odd import DOCS, docs

PATTERNS = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == 2 and 16 <= len(digits) <= 19 and luhn(digits) or kind == 3 and 8 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(7)
    pieces = ["a", "b.c", "@", ".", "-", "+", " ", "1", "23", "255", "256", "(", ")", "4111111111111111", "555-0563", "é", "%", "x@y.z", "10.0.0.1", "\n", "+1 "]
    for _ in range(6000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 200_000, "+1" * 200_000, "a@" * 200_000, "a.@" * 100_000, "1 " * 200_000):
        pii.base_spans(text)


def test_field_gradient_is_exact_on_a_tree():
    """On a chain the beliefs are the marginals of the enumerated distribution."""
    rng = np.random.default_rng(0)
    field = pii.Field(rng.normal(size=(pii.FEATURES, 5)), rng.normal(size=(2, 5, 5)))
    x = (rng.random((3, pii.FEATURES)) < 0.3).astype(float)
    links = np.array([[0, 1, 0], [1, 2, 1]])
    own = x @ field.single
    joint = np.exp(own[0][:, None, None] + own[1][None, :, None] + own[2] + field.pair[0][:, :, None] + field.pair[1][None])
    joint /= joint.sum()
    node, pair = field.beliefs(x, links, 60)
    assert np.allclose(node[0], joint.sum((1, 2))) and np.allclose(node[1], joint.sum((0, 2))) and np.allclose(pair[1], joint.sum(0))


def test_distant_repeats_get_one_label():
    rng = random.Random(1)
    number = lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    texts = []
    for _ in range(200):
        n = number()
        texts.append(f"call +1 {n} now " + "filler words here " * 5 + f"or again +1 {n} and the code {rng.randint(10, 99)} of x=9{rng.randint(10, 99)}a")
    field = pii.fit(texts)
    text = "call +1 (219) 555-0563 today. " + "plain words " * 30 + "dial 219555-0563 please, not 17"
    spans = pii._all_spans([text], field)[0]
    assert (3, 5, 22) in spans and spans[: len(plain(text))] == plain(text)
    alike = [text[s:e] for k, s, e in spans if k >= len(pii.KINDS)]
    assert alike == ["219555-0563"]
    alone = "plain words " * 30 + "dial 219555-0563 please, not 17"
    assert not [s for s in pii._all_spans([alone], pii.Field(field.single, field.pair * 0))[0]]


def test_rows_in_any_state(spark):
    rows = DOCS + [(8, "mail a.b@c.example.org or +1 (219) 555-0563", "en", "a")]
    got = pii.personal_data(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in got}
    assert spans[8] == [("email", 5, 22), ("phone", 26, 43)] and spans[1] == spans[2] == []
    assert pii.personal_data(docs(spark, [])).count() == 0


def test_redaction_covers_overlaps_once(spark):
    field = spark.sparkContext.broadcast(pii.fit([]))
    rows = [(1, "x a@b.cd y +1 555 10.20.30.40", "", ""), (2, None, "", ""), (3, "4111 1111 1111 1111", "", "")]
    got = docs(spark, rows).select("doc_id", pii.redacted("text", field).alias("t")).collect()
    assert {r.doc_id: r.t for r in got} == {1: "x [EMAIL] y [PHONE]", 2: None, 3: "[CARD]"}


@pytest.mark.parametrize("n", [0, 1])
def test_fit_on_nothing_adds_nothing(n):
    assert pii._all_spans(["code 1234567 is here"], pii.fit(["no digits"] * n)) == [[]]
