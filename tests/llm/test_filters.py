import itertools
import random
import re
from collections import Counter

import pytest

from seatwise.llm import filters
from tests.llm.odd import docs


def fails(text, doc_id, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = ""
    found += "A" if len(words) < 200 else ""
    found += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    found += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
    found += "D" if re.search(r"[#$%&*|]", text) else ""
    smaller = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, *_ in rows)
    return found + ("E" if smaller else "")


def brute(rows, labels):
    """Every order applied to every document, one filter after the other."""
    good, toxic = ({d for d, *m in labels if m[k] == 1} for k in (0, 1))
    judged = [(lang or "", fails(text or "", d, rows), d) for d, text, lang, *_ in rows]
    out, shapley = {}, Counter()
    for part in {p for p, *_ in judged}:
        own = [(f, d) for p, f, d in judged if p == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(x in f for f, _ in own) - len(gone), sum(f == x for f, _ in own),
                    sum(d in good for _, d in gone), sum(d in toxic for _, d in gone))
                shapley[part, x] += len(gone)
    return {key: (*row, shapley[key[0], key[1][key[2] - 1]]) for key, row in out.items()}


def got(spark, rows, labels, table=None):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filters.filter_audit(docs(spark, rows) if table is None else table, marks)
    assert found.columns == ["part", "filter_order", "step", *filters.COUNTS, "shapley"]
    rows = found.collect()
    out = {tuple(r)[:3]: tuple(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def some_docs():
    rng = random.Random(1)
    texts = []
    for i in range(120):
        words = [rng.choice(("a", "b", "word", "Word", "und")) if rng.random() < 0.5 else f"w{j}" for j in range(rng.choice((3, 150, 199, 200, 201, 400)))]
        if rng.random() < 0.4:
            words.append(rng.choice(("A" * 12, "A" * 60, "#", "100%", "|")))
        texts.append(rng.choice((" ", "\n", "  \t")).join(words))
    rows = [(i, rng.choice(texts) if rng.random() < 0.3 else t, rng.choice(("en", "de", None, "")), "a") for i, t in enumerate(texts)]
    return rows + rows[:5] + [(500 + i, texts[3], "en", "a") for i in range(30)]


LABELS = [(d, d % 2, d % 3 % 2) for d in range(0, 130, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1)]


def test_equals_all_orders_applied_one_by_one(spark):
    rows = some_docs()
    assert got(spark, rows, LABELS) == brute(rows, LABELS)


def test_odd_rows(spark):
    from tests.llm.odd import DOCS

    assert got(spark, None, [(4, 1, 1)]) == brute(DOCS, [(4, 1, 1)])


def test_no_rows(spark):
    assert got(spark, [], [(1, 1, 1)]) == {}
    assert got(spark, [(1, "x", "en", "a")], []) == brute([(1, "x", "en", "a")], [])


def test_limits_are_met_to_the_word(spark):
    rows = [(i, t, "en", "a") for i, t in enumerate([
        " ".join(f"w{i}" for i in range(n)) for n in (199, 200)
    ] + [" ".join(["x y"] * 2), "x x x y", "A" * 3 + "b" * 97, "A" * 4 + "b" * 96, "é" * 96 + "A" * 4, "Ä" * 50, "x y", "\x0b\x0c x \r"])]
    assert got(spark, rows, []) == brute(rows, [])


def test_any_number_of_filters(spark):
    cells = spark.createDataFrame([("p", 5, 2, 1, 0), ("p", 0, 1, 0, 0)], "part string, mask int, n long, n_good long, n_toxic long")
    rows = {tuple(r)[:3]: tuple(r)[3:] for r in filters.audit(cells, "ABC").collect()}
    assert len(rows) == 18
    assert rows["p", "ABC", 1] == (1, 2, 0, 0, 1, 0, 6) and rows["p", "ABC", 3] == (1, 0, 2, 0, 0, 0, 6)


@pytest.mark.parametrize("letters", ["AB", "ABCDE"])
def test_prefixes_come_level_by_level(spark, letters):
    rows = filters.prefixes(spark, letters).collect()
    per_level = Counter(r.step for r in rows)
    n = len(letters)
    assert per_level == {k: 2**n * len(list(itertools.permutations(letters, k))) for k in range(1, n + 1)}
