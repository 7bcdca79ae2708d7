import random

from pyspark.sql import functions as F

from seatwise.llm import decontaminate
from tests.llm.odd import DOCS, docs, item_words


def brute(rows, items):
    wins = {}
    for item, text in items:
        w = item_words(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + size]), set()).add(str(item) if item is not None else "")
    out = []
    for d, text, *_ in rows:
        w, hit, found = item_words(text), set(), set()
        for size in {len(k) for k in wins}:
            for i in range(len(w) - size + 1):
                if owners := wins.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= owners
        out.append((d, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def some(rng):
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(25)]
    items += [(90, items[3][1]), (None, "W1, w2; w3!"), (91, None), (92, "..."), (93, "größe über alles 日本")]
    rows = list(DOCS)
    for i in range(60):
        text = rng.choices(vocabulary, k=rng.randint(0, 60))
        if i % 2:
            part = item_words(items[rng.randrange(len(items))][1])
            at = rng.randint(0, len(text))
            text[at:at] = part[: rng.randint(0, len(part))] if i % 3 else part
        rows.append((100 + i, ", ".join(text).upper() if i % 5 else " ".join(text), "en", "a"))
    return rows + [(300, "GRößE über alles 日本", "de", "a")], items


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows, items = some(random.Random(seed))
        table = spark.createDataFrame(items, "item_id long, text string").withColumn("win", F.lit("x"))
        report, _ = decontaminate.contamination(docs(spark, rows), table)
        got = [(r.doc_id, r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in report.collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute(rows, items)))


def test_clean_keeps_whole_rows(spark):
    rows, items = some(random.Random(3))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.clean(docs(spark, rows), table)
    assert got.columns == docs(spark, []).columns
    want = [r[:2] for r, b in zip(rows, brute(rows, items)) if not b[4]]
    assert sorted(map(str, [(r.doc_id, r.text) for r in got.collect()])) == sorted(map(str, want))


def test_empty_sides(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    report, spans = decontaminate.contamination(docs(spark), none)
    assert report.filter("contaminated or n_hit > 0").count() == 0 and report.count() == len(DOCS) and spans.count() == 0
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(docs(spark, []), one)[0].count() == 0
