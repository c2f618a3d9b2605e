"""License scan as an exact set-similarity join (DataFrame operations only).

A template of n words is compared with blocks of 2n words at every n words, so any n
words in a row lie in one block. Tokens are ordered by their frequency in the whole
corpus, rarest first, and stand for their places in this order. A block that holds at
least ``need`` of a template's tokens holds one of its first ``size - need + 1``: only
these prefix tokens are looked up (prefix filter). Blocks that the text leaves fewer than
``need`` words are never made (length filter). Of a template matched at its i-th token a
block can hold no more than i tokens before it and what the block has from this token on
in the global order: where these are too few, it goes (positional filter). Only what is
left is intersected with the template.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty

# The base phrases with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Sentences of public licences with the labels of this operator.
NOTICES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "licensed under the apache license version 2 0": "apache-2-notice",
    "you may not use this file except in compliance with the license": "apache-2-header",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-text",
    "licensed under cc by nc 4 0": "cc-by-nc-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided": "bsd-text",
}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    base: bool
    need: int

    @property
    def tokens(self) -> frozenset[str]:
        return frozenset(self.words)


def templates(threshold: float) -> list[Template]:
    """Base phrases must be held whole; notices to the containment threshold."""
    every = [(p, name, True) for p, name in BASE.items()] + [(p, name, False) for p, name in NOTICES.items()]
    return [
        Template(tuple(p.split()), name, base, len(set(p.split())) if base else math.ceil(threshold * len(set(p.split()))))
        for p, name, base in every
    ]


def words_of(text: Column) -> Column:
    """Words of a text whose A-Z are made lower case."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def token_order(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Place of each template token in the order of frequency over the corpus, rarest first.

    The result has one entry per token of the templates, whatever the corpus.
    """
    known = F.filter("words", lambda w: w.isin(vocabulary))
    counted = words.select(F.explode(known).alias("token")).groupBy("token").count().collect()
    seen = {r["token"]: r["count"] for r in counted}
    return {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (seen.get(t, 0), t)))}


#: A hit is place x CODES + rank; the templates have fewer tokens than this.
CODES = 1024


def blocks(docs: DataFrame, id_col: str, text_col: str, plan: list[Template]) -> DataFrame:
    """One row per text, prefix token found in it, template of the token and block that holds it.

    Columns: row, id, n_words, of the template (template, n, need, label, base, size), start (first word of
    the block), may (the positional filter's verdict), shared (tokens in common; 0 where it
    may not), places (starts of a base phrase). Texts without a block have one row of nulls.
    """
    vocabulary = sorted(set().union(*(t.tokens for t in plan)))
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(text_or_empty(text_col)).alias("words"))
    order = token_order(words.select("words"), vocabulary)
    index = []
    for k, t in enumerate(plan):
        ranked = sorted(order[x] for x in t.tokens)
        for i, rank in enumerate(ranked[: len(ranked) - t.need + 1]):
            index.append((rank, k, len(t.words), i, ranked, t.need, [order[w] for w in t.words], t.label, t.base))
    prefixes = docs.sparkSession.createDataFrame(index, "rank long, template int, n int, place int, tokens array<long>, need int, phrase array<long>, label string, base boolean")
    first = sorted({r[0] for r in index})
    of = sorted(vocabulary, key=order.get)

    placed = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("token")))
    hits = F.transform(F.filter(placed, lambda h: h["token"].isin(vocabulary)), lambda h: h["at"].cast("long") * CODES + F.array_position(F.array(*map(F.lit, of)), h["token"]) - 1)
    # Most texts hold no prefix token and need no list of hits.
    some = F.when(F.arrays_overlap("words", F.array(*[F.lit(of[r]) for r in first])), hits)
    found = words.select("row", "id", F.size("words").alias("n_words"), some.alias("hits"))
    starts = F.filter(F.transform("hits", lambda c, i: F.struct(c.alias("code"), i.alias("i"))), lambda h: (h["code"] % CODES).isin(first))
    reach = 2 * max(len(t.words) for t in plan)
    found = found.select("row", "id", "n_words", "hits", F.explode_outer(starts).alias("h")).select(
        "row", "id", "n_words", (F.col("h.code") % CODES).alias("hit"), F.floor(F.col("h.code") / CODES).alias("at"),
        F.slice("hits", F.greatest(F.lit(0), F.col("h.i") - reach) + 1, F.lit(2 * reach + 1)).alias("near"),
    )
    # The index has one row per prefix token of the templates: its size is fixed by the parameters.
    paired = found.join(F.broadcast(prefixes), F.col("hit") == F.col("rank"), "left")
    number = F.floor(F.col("at") / F.col("n"))
    long_enough = F.filter(F.array(number - 1, number), lambda b: (b >= 0) & (F.col("n_words") - b * F.col("n") >= F.col("need")))
    paired = paired.withColumn("block", F.explode_outer(long_enough)).withColumn("start", F.col("block") * F.col("n"))
    inside = paired.withColumn("inside", F.filter("near", lambda c: (c >= F.col("start") * CODES) & (c < (F.col("start") + 2 * F.col("n")) * CODES)))
    held = inside.withColumn("held", F.array_distinct(F.transform("inside", lambda c: c % CODES)))
    may = F.col("place") + F.size(F.filter("held", lambda r: r >= F.col("rank"))) >= F.col("need")
    judged = held.withColumn("may", may).withColumn("shared", F.when(F.col("may"), F.size(F.array_intersect("tokens", "held"))).otherwise(0))

    def stands(word):
        return F.forall(F.transform("phrase", lambda r, k: (word + k) * CODES + r), lambda c: F.array_contains("inside", c))

    word = F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)
    places = F.when(F.col("base") & (F.col("shared") >= F.col("need")), F.filter(word, stands))
    return judged.select("row", "id", "n_words", "template", "n", "need", "label", "base", F.size("tokens").alias("size"), "start", "may", "shared", places.alias("places"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """License finds of each row.

    Returns ``id_col``, n_words, n_base (places of base phrases), first_word and last_word
    (smallest and largest start of these places, else null), base_labels, labels (sorted,
    comma-joined, empty if none), score (largest containment of a template in a block
    that meets its threshold, else 0). Null and empty texts have no words. Repeated
    rows and null ids are rows of their own; an empty table gives no rows; other columns
    are ignored.
    """
    found = blocks(docs, id_col, text_col, templates(threshold))
    meets = F.col("shared") >= F.col("need")
    notice = meets & ~F.col("base")
    grouped = found.groupBy("row").agg(
        F.first("id").alias(id_col),
        F.first("n_words").cast("long").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set(F.transform("places", lambda w: F.struct("template", w.alias("word")))))).alias("places"),
        F.collect_set(F.when(F.size("places") > 0, F.col("label"))).alias("base_set"),
        F.collect_set(F.when(notice, F.col("label"))).alias("own_set"),
        F.max(F.when(notice, F.col("shared") / F.col("size"))).alias("containment"),
    )
    starts_of = F.transform("places", lambda p: p["word"])
    return grouped.select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts_of).cast("long").alias("first_word"),
        F.array_max(starts_of).cast("long").alias("last_word"),
        F.array_join(F.array_sort("base_set"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_set", "own_set")), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def op1_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License finds of every document; nulls, repeated rows and empty tables as in ``scan``."""
    return scan(documents(spark, sf_dir))


def oracle(threshold: float = 0.8) -> str:
    """DuckDB SQL of the same finds: every block of every template, without filters."""
    rows = ", ".join(
        f"({k}, {list(t.words)!r}, {sorted(t.tokens)!r}, '{t.label}', {str(t.base).lower()}, {t.need}, {len(t.words)})" for k, t in enumerate(templates(threshold))
    )
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH t(template, phrase, tokens, label, base, need, n) AS (VALUES {rows}),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{pattern}') AS w FROM documents
), r AS (
  SELECT d.doc_id, t.*, unnest(range(0, CAST(ceil(len(w) / n) AS BIGINT))) AS x, w FROM d CROSS JOIN t
), b AS (
  SELECT doc_id, template, phrase, label, base, need, n, len(tokens) AS size, x * n AS start, list_slice(w, x * n + 1, x * n + 2 * n) AS held,
    len(list_intersect(tokens, list_slice(w, x * n + 1, x * n + 2 * n))) AS shared FROM r
), m AS (SELECT * FROM b WHERE shared >= need),
p0 AS (SELECT doc_id, label, start, held, phrase, n, unnest(range(0, n)) AS i FROM m WHERE base),
p AS (SELECT DISTINCT doc_id, label, start + i AS word, phrase FROM p0 WHERE list_slice(held, i + 1, i + n) = phrase),
pg AS (SELECT doc_id, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word FROM p GROUP BY doc_id),
l AS (SELECT DISTINCT doc_id, label, true AS base FROM p UNION SELECT DISTINCT doc_id, label, false FROM m WHERE NOT base),
lg AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM l GROUP BY doc_id
), sg AS (SELECT doc_id, max(shared / size) AS containment FROM m WHERE NOT base GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(containment, 0.0) END AS score
FROM d LEFT JOIN pg USING (doc_id) LEFT JOIN lg USING (doc_id) LEFT JOIN sg USING (doc_id)
"""
