import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from seatwise.llm import pieces
from seatwise.llm.queries import op11_piece_ids
from tests.llm.odd import LONG, docs

PATH = public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"
ALPHABETS = [
    "ab ", " ▁a\n\t", "abcdefghijklmnopqrstuvwxyzABC0123456789.,;:!?-_/()[]{}<>=+*&^%$#@~`'\"\\| \n▁",
    "日本語中文한국어 édüñ ß🙂👍🏽‍́\x00\x01�\U00012000", "    x", "<s></s><unk><0x0A> ", "aaaab", "thein ",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as file:
        return pieces.Model(file.read())


def some_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice(ALPHABETS) + (rng.choice(ALPHABETS) if rng.random() < 0.3 else "")
        yield "".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 3, 5, 10, 30, 300))))


def test_ids_are_those_of_the_library(library, model):
    texts = [*some_texts(1, 3000), "", None, LONG, " " * 5000, "x" * 5000, "日本" * 3000, "a b" * 5000]
    got = pieces.Encoder(model).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == library.encode(text or ""), text


def test_a_word_of_hundreds_of_thousands_of_letters(library, model):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij0123456789") for _ in range(200_000))
    assert pieces.Encoder(model).encode([text])[0].tolist() == library.encode(text)


@pytest.mark.parametrize("block, remembered", [(7, 3), (1 << 20, 1 << 17)])
def test_blocks_and_forgetting_change_nothing(library, model, monkeypatch, block, remembered):
    monkeypatch.setattr(pieces, "BLOCK", block)
    monkeypatch.setattr(pieces, "REMEMBERED", remembered)
    texts = list(some_texts(3, 300))
    got = pieces.Encoder(model).encode(texts)
    assert [x.tolist() for x in got] == [library.encode(t) for t in texts]


def test_a_rank_that_opens_an_earlier_one_is_merged_once_a_round(library, model):
    """Ranks whose merge opens a merge of no later rank exist, and taking all their pairs at once would differ."""
    assert model.hasty.any()
    texts = [p.replace(pieces.SPACE, " ").strip() * k for p in (library.id_to_piece(i) for i in range(300, 6000)) for k in (2, 3)]
    assert [x.tolist() for x in pieces.Encoder(model).encode(texts)] == [library.encode(t) for t in texts]
    plain = pieces.Model.__new__(pieces.Model)
    plain.__dict__.update(model.__dict__, hasty=np.zeros_like(model.hasty), last_by_pass=False)
    many = [" " * n + "x" for n in range(1, 60)]
    assert [x.tolist() for x in pieces.Encoder(plain).encode(many)] != [library.encode(t) for t in many]


def test_any_ids_decode_as_by_the_library(library, model):
    rng = random.Random(4)
    lists = [
        [rng.choice((rng.randrange(32000), rng.randrange(262))) for _ in range(rng.randrange(9))] for _ in range(5000)
    ]
    flat = np.array([i for ids in lists for i in ids], np.int64)
    got = model.decode_flat(flat, np.array([len(ids) for ids in lists]))
    assert [t.decode() for t in got] == [library.decode(ids) for ids in lists]
    with pytest.raises(ValueError):
        model.decode_flat(np.array([32000]), np.array([1]))


def test_a_model_that_normalises_is_refused():
    class Other:
        def normalize(self, text):
            return text.lower()

    with pytest.raises(ValueError):
        pieces.Model._same_text(Other())


@pytest.mark.parametrize("rows", [None, []])
def test_odd_rows(spark, library, rows):
    model, table = pieces.load(spark, PATH), docs(spark, rows)
    encoded = pieces.encode(table, "doc_id", "text", model)
    back = pieces.decode(encoded, "key", "ids", model).collect()
    want = sorted((str(r.doc_id), library.encode(r.text or "")) for r in table.collect())
    assert sorted((str(r.key), r.ids) for r in back) == want
    assert all(r.text == library.decode(r.ids) for r in back)
    texts = encoded.select("key", F.when(F.size("ids") > 0, F.col("ids")).alias("ids"))  # null lists
    assert all(r.text == library.decode(r.ids or []) for r in pieces.decode(texts, "key", "ids", model).collect())


def test_query_against_the_library(spark, library):
    import hashlib

    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in rows:
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, op11_piece_ids(spark, FOLDER).collect())) == sorted(want)
