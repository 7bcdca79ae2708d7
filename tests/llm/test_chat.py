import random

from pyspark.sql import functions as F

from seatwise.llm import chat

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<~s>", "[~~INST]", "<", "~", "[", "/", "s>", "\n", "é", "日", "x y", "</s", "INST]"]


def test_round_trip_with_control_strings(spark):
    rng = random.Random(5)
    text = lambda: "".join(rng.choices(PIECES, k=rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", text(), None]), rng.choice([text(), text(), None])) for c in range(80) for t in range(rng.randint(1, 6))]
    rows += [(500, None, "user", "first"), (500, 2, "user", "b"), (500, 2, "user", "a"), (500, 2, "user", "a"), (None, 0, "assistant", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("log", "n", "seq", "parts", "loss"):
        table = table.withColumn(name, F.lit(1))
    shown = chat.render(chat.fold_events(chat.as_events(table)))
    got = shown.select("conv_id", "formatted", "loss", chat.read_back(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss")).alias("learnt")).collect()
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    assert len(got) == len({r[0] for r in rows})
    for g in got:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == g.conv_id), key=order)]
        assert [(t.role, t.text) for t in g.turns] == want
        assert g.learnt == "".join(t for r, t in want if r == "assistant")
        assert g.formatted.count("</s>") == len(want) and g.formatted.count("[INST]") == len(want)


def test_escape_is_reversible_and_hides_controls(spark):
    rng = random.Random(6)
    rows = [("".join(rng.choices(PIECES, k=rng.randint(0, 20))),) for _ in range(500)]
    out = spark.createDataFrame(rows, "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in out.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_events_fold_into_messages(spark):
    log = [
        (1, 1, 0, "message", "user", "hello"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", None, "a"),
        (1, 4, 1, "delta", None, "b"), (1, 5, 0, "edit", None, "hello there"), (1, 6, 1, "regenerate", "assistant", None),
        (1, 8, 1, "delta", None, "d"), (1, 7, 1, "delta", None, "c"), (1, 9, 2, "message", "user", "gone"),
        (1, 10, 2, "delete", None, None), (1, 11, 3, "message", "user", "x"), (1, 12, 3, "delete", None, None),
        (1, 13, 3, "delta", None, "back"), (1, 14, 4, "noise", "user", "?"), (1, 15, 5, None, "user", "?"),
        (2, 1, 0, "delta", "assistant", "only"), (2, 2, 0, "delta", None, None),
    ]
    table = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold_events(table).collect()}
    assert got == {
        (1, 0): ("user", "hello there"), (1, 1): ("assistant", "cd"), (1, 3): ("user", "back"), (2, 0): ("assistant", "only"),
    }


def test_empty_log(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.render(chat.fold_events(chat.as_events(table))).count() == 0


def test_no_python_in_the_plan(spark):
    from seatwise.llm.queries import op10_chat_format

    plan = op10_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
