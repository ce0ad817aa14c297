"""License scans by diagonal voting, by DataFrame functions only.

All rolling 3-word hashes of the texts are joined to the places of the same 3 words in the templates. A match votes
for a diagonal (place in the text less place in the template); votes of near diagonals, apart by an inserted or left
out word, are merged, and the span's words are compared with the template's own 3-word runs. Short phrases are
templates too; where the join finds a phrase's first 3 words, its words are compared one by one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: Words by which diagonals of one copy may differ, and the share of a template that labels a document.
DRIFT, SHARE = 4, 0.7
#: Bytes of templates that may go to every task.
TEMPLATE_BYTES = 1 << 20
#: Hash values that tell places which may be a template's from those that aren't.
SIEVE = 1 << 16
#: Repeated rows that are given back from one array.
COPIES = 4096

# Phrases of the contract (words, label), and notices as they are commonly written.
PHRASES = (("the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "dedicated to the public domain under the CC0 1.0 Universal dedication"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of letters, digits and characters above ASCII, A-Z lower-cased.

    Two characters above ASCII have ASCII letters as their lower case; others take their place first, which changes
    neither a word's bounds nor its equality with words of ASCII.
    """
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é")), F.lit("İ"), F.lit("é"))
    return F.array_remove(F.split(F.lower(plain), SPLIT), "")


def grams(words_: str) -> Column:
    """Hashes of each 3 words on end."""
    n = F.size(words_)
    return F.when(n >= GRAM, F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: F.xxhash64(F.get(words_, i), F.get(words_, i + 1), F.get(words_, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def template_table(spark, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """id, label, phrase (whether a base phrase), text."""
    rows = [(i, label, True, text) for i, (text, label) in enumerate(phrases)]
    rows += [(i, label, False, text) for i, (label, text) in enumerate(templates, len(rows))]
    quoted = ", ".join(f"({i}, '{label}', {str(p).lower()}, '{text.replace(chr(39), chr(92) + chr(39))}')" for i, label, p, text in rows)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t(id, label, phrase, text)")


def scan(docs: DataFrame, templates: DataFrame, share: float = SHARE) -> DataFrame:
    """The licenses of each document.

    docs: doc_id, text (more columns are ignored); templates: id, label, phrase, text. Returns doc_id, n_words, n_base
    (places where a base phrase stands), first_word and last_word (their least and greatest start, else null),
    base_labels and labels (those of phrases; these and the method's; distinct, sorted, comma-joined) and score (1
    with a phrase, else the greatest share of a template's 3-word runs that a merged diagonal has). A null or empty
    text has no words. Phrases of under three words are not searched for. Repeated rows (of equal doc_id and text) are
    scanned together and give a row each; a document of any length votes in sums, never in lists.
    """
    own = templates.select("id", "label", "phrase", words(F.col("text")).alias("t_words"))
    facts = own.agg(F.coalesce(F.sum(F.size("t_words")), F.lit(0)).alias("n"), F.max(F.when(F.col("phrase"), F.size("t_words"))).alias("most")).first()
    most = max(GRAM, facts["most"] or 0)  # words that a place is compared by
    here = F.slice("t_words", F.col("t_at") + 1, F.when(F.col("phrase"), F.size("t_words")).otherwise(GRAM))
    table = own.select("*", F.posexplode(grams("t_words")).alias("t_at", "gram")).filter("NOT phrase OR t_at = 0")
    table = table.select("id", "label", "phrase", F.size("t_words").alias("t_size"), "t_at", "gram", here.alias("t_here"))
    known = None
    if 64 * facts["n"] <= TEMPLATE_BYTES:
        # places whose hash no template has, by 16 of its bits, aren't sent to the join
        bits = {r["b"] for r in table.select(F.pmod("gram", F.lit(SIEVE)).alias("b")).distinct().collect()}
        known = F.from_json(F.lit(json.dumps([int(b in bits) for b in range(SIEVE)])), "array<tinyint>")
        table = F.broadcast(table)
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    n = F.size("words")
    # a place has its own few words (slice would copy the whole text each time); place -1 stands for the document itself
    place = lambda i: F.struct(i.alias("at"), F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("gram"))
    here = lambda x: F.struct(x["at"].alias("at"), x["gram"].alias("gram"), F.array(*(F.get("words", x["at"] + j) for j in range(most))).alias("here"))
    hashed = F.transform(F.sequence(F.lit(0), n - GRAM), place)
    if known is not None:
        hashed = F.filter(hashed, lambda x: F.get(known, F.pmod(x["gram"], F.lit(SIEVE)).cast("int")) == 1)
    itself = F.struct(F.lit(-1).alias("at"), F.lit(None).cast("bigint").alias("gram"), F.array().cast("array<string>").alias("here"))
    places = F.when(n >= GRAM, F.concat(F.array(itself), F.transform(hashed, here))).otherwise(F.array(itself))
    each = base.select("doc_id", "text_hash", n.alias("n"), F.explode(places).alias("x")).select("doc_id", "text_hash", "n", "x.at", "x.gram", "x.here")
    joined = each.withColumn("spread", F.when(F.col("at") == -1, F.col("text_hash")).otherwise(F.col("gram"))).join(
        table.withColumnRenamed("gram", "t_gram"), (F.col("spread") == F.col("t_gram")) & (F.col("at") >= 0), "left"
    ).filter("at = -1 OR id IS NOT NULL")
    # verified: the words themselves, not their hash
    same = F.slice("here", 1, F.size("t_here")) == F.col("t_here")
    votes = joined.select(
        "doc_id",
        "text_hash",
        F.when(F.col("at") == -1, F.col("n")).alias("n"),
        "id",
        "label",
        "phrase",
        "at",
        "t_at",
        F.when(F.col("phrase") & same, F.col("at")).alias("base_at"),
        F.when(~F.col("phrase") & same, F.col("at") - F.col("t_at")).alias("diagonal"),
        (F.col("t_size") - (GRAM - 1)).alias("runs"),
    )
    # two staggered bands of diagonals, so that neighbours share one of them
    bands = F.array(F.floor(F.col("diagonal") / (2 * DRIFT)), F.floor((F.col("diagonal") + DRIFT) / (2 * DRIFT)))
    banded = votes.select("*", F.posexplode_outer(F.when(F.col("diagonal").isNotNull(), bands)).alias("shift", "band"))
    spans = banded.groupBy("doc_id", "text_hash", "id", "label", "phrase", "runs", "shift", "band").agg(
        F.max("n").alias("n"),
        F.count("n").alias("copies"),
        F.count("base_at").alias("n_base"),
        F.min("base_at").alias("first_word"),
        F.max("base_at").alias("last_word"),
        F.size(F.collect_set("t_at")).alias("t_seen"),
    )
    covered = F.when(F.col("band").isNotNull(), F.col("t_seen") / F.col("runs"))
    found = spans.groupBy("doc_id", "text_hash").agg(
        F.max("n").cast("long").alias("n_words"),
        F.sum("copies").alias("copies"),
        F.sum("n_base").cast("long").alias("n_base"),
        F.min("first_word").cast("long").alias("first_word"),
        F.max("last_word").cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("n_base") > 0, F.col("label"))).alias("base"),
        F.collect_set(F.when((F.col("n_base") > 0) | (covered >= share), F.col("label"))).alias("every"),
        F.coalesce(F.max(covered), F.lit(0.0)).alias("best"),
    )
    # a row for each of the repeated rows, by way of short arrays
    rows = found.withColumn("some", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    rows = rows.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("some") * COPIES))))
    return rows.select(
        "doc_id",
        "n_words",
        F.floor(F.col("n_base") / F.col("copies")).alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort("every"), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("best")).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), template_table(spark))


def sql(phrases=PHRASES, templates=TEMPLATES) -> str:
    """The same rows by DuckDB: votes by equal words instead of hashes."""
    rows = [(i, label, True, text) for i, (text, label) in enumerate(phrases)]
    rows += [(i, label, False, text) for i, (label, text) in enumerate(templates, len(rows))]
    quoted = ", ".join(f"({i}, '{label}', {str(p).lower()}, '{text}')" for i, label, p, text in rows)
    ws = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '')"
    return f"""
WITH t0(id, label, phrase, text) AS (VALUES {quoted}),
t AS (SELECT id, label, phrase, {ws} AS tw FROM t0),
tg AS (SELECT id, label, phrase, tw, j - 1 AS t_at, array_to_string(tw[j:j + 2], ' ') AS k FROM t, unnest(range(1, len(tw) - 1)) AS r(j)),
d AS (SELECT doc_id, {ws} AS ws FROM documents),
v AS (SELECT doc_id, id, label, phrase, i - 1 AS pos, t_at, len(tw) - 2 AS runs, phrase AND t_at = 0 AND array_to_string(ws[i:i + len(tw) - 1], ' ') = array_to_string(tw, ' ') AS hit
  FROM (SELECT doc_id, ws, i, array_to_string(ws[i:i + 2], ' ') AS k FROM d, unnest(range(1, len(ws) - 1)) AS r(i)) JOIN tg USING (k)),
b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM v WHERE hit GROUP BY doc_id),
s AS (SELECT doc_id, label, count(DISTINCT t_at) / max(runs) AS share FROM v, (VALUES (0), ({DRIFT})) AS o(o) WHERE NOT phrase GROUP BY doc_id, id, label, o, floor((pos - t_at + o) / {2 * DRIFT})),
m AS (SELECT doc_id, max(share) AS best FROM s GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM v WHERE hit UNION SELECT doc_id, label FROM s WHERE share >= {SHARE}) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN l USING (doc_id)
"""
