"""The corpus operators as registered queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.llm import (
    chat, decontaminate, filters, html, langid, lm, mixing, neighbours, pieces, pii, quality, simhash, whitening,
)
from seatwise.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(read(spark, folder, "documents"))


def op2_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(read(spark, folder, "documents"))


def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = html.main_texts(read(spark, folder, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(read(spark, folder, "documents"))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    line = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))
    ), ",")
    base = F.filter("spans", lambda s: s.kind.isin(*pii.KINDS))
    return found.select(
        "doc_id", *[of_kind(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
    )


def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return neighbours.search(rows, F.col("id") % 50 == 0, 5)


def op7_contamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = read(spark, folder, "documents"), read(spark, folder, "benchmark")
    report, _ = decontaminate.contamination(docs, items)
    return report.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


def op8_mixing_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    said = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")),
                             F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("m")
    more = spark.range(1).select(said).select(
        F.lit(-7).cast("long"), F.col("m.turn").cast("long"), "m.role", F.lit("</s>[INST] ok [/INST]")
    )
    messages = chat.fold_events(chat.as_events(rows.union(more)))
    shown = chat.render(messages)
    back = F.array_join(F.transform(
        chat.read_back(F.col("formatted")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))
    ), "")
    learnt = chat.under_mask(F.col("formatted"), F.col("loss"))
    return shown.select(
        "conv_id", F.size(chat.read_back(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(back, 256).alias("turns_sha256"), F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_piece_ids(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    model = pieces.load(spark, public_tokenizers.path("piece_bpe_32k.model"))
    encoded = pieces.encode(read(spark, folder, "documents"), "doc_id", "text", model)
    return pieces.decode(encoded, "key", "ids", model).select(
        F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return whitening.whiten(rows)


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filters.filter_audit(read(spark, folder, "documents"), read(spark, folder, "labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_language_model, op2_simhash_groups, op3_language, op4_main_text, op5_personal_data, op6_neighbours,
        op7_contamination, op8_mixing_schedule, op9_quality, op10_chat_format, op11_piece_ids, op12_whitening,
        op13_filter_audit,
    )
}

# Windows of 13 item words against all runs of words of the same lengths.
_CONTAMINATION = r"""
WITH
lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM lowered),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM items, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
runs AS (
  SELECT rid, size, p, array_to_string(w[p:p + size - 1], ' ') AS win
  FROM docs, (SELECT DISTINCT size FROM wins), unnest(range(1, len(w) - size + 2)) AS u(p)),
hits AS (SELECT rid, p, size, item_id FROM runs JOIN wins USING (size, win)),
words AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + size)) AS q FROM hits) GROUP BY rid),
owners AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN owners USING (rid)
"""

_CHAT = r"""
WITH said AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(role, '([<\[])(~*)(/?s>|/?INST\])', '\1~\2\3', 'g'))
          + length(regexp_replace(text, '([<\[])(~*)(/?s>|/?INST\])', '\1~\2\3', 'g'))
          + length('<s>[INST][/INST]</s>') AS n
  FROM said)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

# All orders by joins of distinct letters; every step is judged on the documents themselves, folded by what they fail.
_FILTERS = r"""
WITH
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         concat(CASE WHEN len(words) < 200 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
                CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS failed
  FROM w JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
folded AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
  FROM judged GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
  JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, step, filter_order[step] AS x, filter_order[1:step - 1] AS before
          FROM orders, unnest(range(1, 6)) AS u(step)),
seen AS (
  SELECT part, filter_order, step, x, n, n_good, n_toxic, failed,
         before <> '' AND regexp_matches(failed, '[' || before || '_]') AS gone, contains(failed, x) AS fails
  FROM folded, steps),
counted AS (
  SELECT part, filter_order, step, x,
         sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = x THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND fails THEN n_good ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT gone AND fails THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, x)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counted
"""

ORACLES: dict[str, str] = {
    "op7_contamination": _CONTAMINATION, "op10_chat_format": _CHAT, "op13_filter_audit": _FILTERS,
}
