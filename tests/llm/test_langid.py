from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from seatwise.llm import langid
from tests.llm.odd import DOCS, docs


def test_scores_equal_plain_bayes(spark):
    rows = [(i, t, l, "a") for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr"), ("the house", "en"), ("", "en"), ("das Haus", None)])]
    (model,) = [m.value for m in langid.learn(docs(spark, rows))]
    counts = {l: sum((langid.grams(t) for _, t, k, _ in rows if k == l), np.zeros(1 << langid.BITS)) for l in ("de", "en", "fr")}
    prior = {"de": 2 / 8, "en": 4 / 8, "fr": 2 / 8}
    for text in ("the dog", "die Katze", "le chien et la", "Ünder"):
        joint = {}
        for l, c in counts.items():
            p = (c + langid.SMOOTH) / (c + langid.SMOOTH).sum()
            joint[l] = np.log(prior[l]) + (langid.grams(text) * np.log(p)).sum()
        best = max(joint, key=joint.get)
        lang, score = model.predict(text)
        assert lang == best and abs(score - 1 / sum(np.exp(v - joint[best]) for v in joint.values())) < 1e-3


def test_grams_count_letters_in_lower_case():
    assert langid.grams("Ab1 ab").sum() == 3 * (len(" ab  ab ") - 1)
    assert (langid.grams("AB ab") == langid.grams("ab AB")).all() and (langid.grams("a!b") == langid.grams("a?b")).all()


def test_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.98


def test_rows_in_any_state(spark):
    got = langid.identify(docs(spark)).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 for r in got)
    assert Counter(r.lang_pred for r in got if r.doc_id in (1, 2, 5, 6)) == {"und": 4}
    assert all(r.lang_pred != "und" for r in got if r.doc_id in (3, 4, 7, None))
    assert {r.lang_pred for r in langid.identify(docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs(spark, [])).count() == 0


def test_blocks_of_languages_give_the_same(spark, monkeypatch):
    texts = [(i, f"text {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * (1 + i % 3), f"l{i % 70}", "a") for i in range(210)]
    table = docs(spark, texts + [(i, None if i % 2 else "12 34", "l1", "a") for i in range(300, 304)])
    one = sorted(map(tuple, langid.identify(table).collect()))
    assert len({r[2] for r in one}) > 20
    for languages in (1, 32):
        monkeypatch.setattr(langid, "CELLS", languages << langid.BITS)
        models = [m.value for m in langid.learn(table)]
        assert [len(m.languages) for m in models] == ([1] * 70 if languages == 1 else [32, 32, 6])
        assert sum((m.languages for m in models), []) == sorted({f"l{i}" for i in range(70)})
        if languages > 1:
            got = sorted(map(tuple, langid.identify(table).collect()))
            assert [r[:3] for r in got] == [r[:3] for r in one]
            assert np.allclose([r[3] for r in got], [r[3] for r in one], atol=1e-9)


def test_more_languages_than_one_matrix_holds(spark, monkeypatch):
    rows = spark.range(1100).selectExpr("id AS doc_id", "concat('word ', repeat(char(97 + id % 26), 3)) AS text", "concat('l', id) AS lang", "'a' AS source")
    assert [len(m.value.languages) for m in langid.learn(rows)] == [1024, 76]
    got = langid.identify(rows)
    assert got.count() == 1100 and got.filter("lang_pred = 'und'").count() == 0
