"""Chat formatting: logs of conversation events folded into final messages, rendered and read back.

Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of the template and their parts, for patterns.
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = r"([<\[])(~*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])~(~*)(/?s>|/?INST\])"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    """Control strings get a ``~`` after their first sign, and what already looks so gets one more."""
    return F.regexp_replace(text, _CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the final messages of ``events(conv_id, seq, turn, kind, role, text)``.

    Kinds: ``message`` (begins or replaces a turn's text), ``delta`` (adds to it), ``edit``
    (replaces it, from the user's side), ``regenerate`` (drops what the turn had; deltas may follow),
    ``delete`` (takes the turn out until a later event sets it again). Events apply by ``seq``, ties by
    kind, role and text; null text is empty and a null role leaves the role as it is. Another or
    null kind raises nothing and changes nothing. A turn without any event that sets it does not
    exist. Events meet per turn, so that a conversation is never gathered while it is folded;
    what a turn's last reset makes void is left out before the deltas are joined.
    """
    e = events.select(
        F.col("conv_id"), F.col("turn"), F.col("seq"), F.lower("kind").alias("kind"), F.col("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).filter(F.col("kind").isin("message", "delta", "edit", "regenerate", "delete"))
    one = F.struct("seq", "kind", "role", "text")
    turns = e.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(one)).alias("log"))
    n = F.size("log")
    resets = F.transform("log", lambda x, i: F.when(x.kind != "delta", i + 1).otherwise(0))
    last = F.array_max(resets)
    turns = turns.withColumn("last", last).withColumn(
        "live", F.slice("log", F.greatest("last", F.lit(1)), n - F.greatest("last", F.lit(1)) + 1)
    )
    gone = (F.col("live")[0].kind == "delete") & (F.size("live") == 1)
    added = F.transform(
        F.filter("live", lambda x: ~x.kind.isin("regenerate", "delete")), lambda x: x.text
    )
    roles = F.filter(F.transform("log", lambda x: x.role), lambda r: r.isNotNull())
    role = F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit(""))
    return turns.filter(~gone).select(
        "conv_id", "turn", role.alias("role"), F.array_join(added, "").alias("text")
    )


def as_events(rows: DataFrame) -> DataFrame:
    """The log of ``conversations(conv_id, turn, role, text)``: a message for each row. Rows that share
    a turn stay messages of their own, in the order of role and text."""
    part = ["conv_id", "turn"]
    own = rows.select(*part, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    same = own.groupBy(*part, "role", "text").agg(F.count("*").alias("n"))
    met = same.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("role", "text", "n"))).alias("m"))
    many = F.flatten(F.transform("m", lambda x: F.array_repeat(F.struct(x.role, x.text), x.n.cast("int"))))
    each = met.select(*part, F.posexplode(many).alias("i", "e"))
    return each.select(
        "conv_id", F.struct("turn", "i").alias("turn"), F.col("i").alias("seq"),
        F.lit("message").alias("kind"), F.col("e.role").alias("role"), F.col("e.text").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: each conversation of ``messages(conv_id, turn, role, text)`` as one
    text, and the spans (start, length, in code points) that a model learns from.

    A turn is ``<s>[INST]role[/INST]text</s>``, with control strings inside role and text
    escaped. Turns come in their order; a null turn comes first. A conversation is one row here,
    as its text is one value.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(BEGIN + OPEN), escape(t.role), F.lit(CLOSE))
    parts = F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), escape(t.text).alias("body"), (t.role == TRAINED).alias("learn")
    ))
    parted = whole.select("conv_id", parts.alias("parts"))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit(END))), "")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(a, p):
        start = a.at + p.size_head
        span = F.array(F.struct(start.alias("start"), p.size.alias("length")))
        spans = F.when(p.learn, F.concat(a.spans, span)).otherwise(a.spans)
        return F.struct((start + p.size + len(END)).alias("at"), spans.alias("spans"))

    sizes = F.transform("parts", lambda p: F.struct(
        F.char_length(p.head).alias("size_head"), F.char_length(p.body).alias("size"), p.learn.alias("learn")
    ))
    loss = F.aggregate(sizes, begin, step, lambda a: a.spans)
    return parted.select("conv_id", formatted.alias("formatted"), loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a rendered conversation."""
    pieces = F.filter(F.split(formatted, END, -1), lambda x: x != "")
    head = len(BEGIN + OPEN)
    return F.transform(pieces, lambda x: F.struct(
        unescape(F.substring(x, F.lit(head + 1), F.locate(CLOSE, x) - head - 1)).alias("role"),
        unescape(F.substring(x, F.locate(CLOSE, x) + len(CLOSE), F.char_length(x))).alias("text"),
    ))


def under_mask(formatted: Column, loss: Column) -> Column:
    """The unescaped text of the loss spans, put together."""
    cut = lambda s: unescape(F.substring(formatted, s.start + 1, s.length))
    return F.array_join(F.transform(loss, cut), "")
