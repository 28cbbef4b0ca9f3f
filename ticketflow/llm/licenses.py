"""License notices in documents by diagonal voting, in DataFrame functions alone.

All runs of ``GRAM`` words of a document are hashed and joined to the places of the same runs in the templates, a small table; the
words themselves are compared behind the join. A meeting of document word ``i`` and template word ``j`` votes for the diagonal
``i - j``: a notice that is repeated word by word fills one diagonal, and one with words put in or left out several that lie
next to each other. Diagonals at most ``DRIFT`` apart are merged; a merged span is verified if its words cover ``COVER`` of the
template. Where spans of several templates overlap, the one with most words counts.

Documents are read once: each sends one row of its own past the join, so the row that a hit belongs to needs no key in the data.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import prepare, stage
from .registry import query

GRAM, DRIFT, COVER, LONGEST = 3, 4, 0.8, 60
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases whose every place counts, and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Wordings of public license notices.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
            "software foundation"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by "
             "the free software foundation"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by "
             "the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
              "distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
)


def parts(phrases, notices) -> list[tuple[int, str, bool, list[str]]]:
    """``(template, label, base, words)``; a notice of more than ``LONGEST`` words is cut into templates of its own."""
    out = []
    for base, given in ((True, phrases), (False, notices)):
        for label, text in given:
            words = text.split()
            if len(words) < GRAM or not re.fullmatch("[a-z0-9 ]+", text) or "," in label or base and len(words) > LONGEST:
                raise ValueError(f"not {GRAM} words or more of a-z and 0-9, or a comma in its label: {label}, {text}")
            n = -(-len(words) // LONGEST)
            size = -(-len(words) // n)
            out += [(label, base, words[i:i + size]) for i in range(0, len(words), size) if len(words[i:i + size]) >= GRAM]
    return [(i, *p) for i, p in enumerate(out)]


def words_of(text: str) -> Column:
    """The words of a text; A-Z are lowered, and what else is lowered is no letter of a template."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    upper = "".join(map(chr, range(65, 91)))
    odd = F.contains(content, F.lit("\u0130")) | F.contains(content, F.lit("\u212A"))  # lower() makes ASCII letters of these two
    lowered = F.when(odd, F.translate(content, upper, upper.lower())).otherwise(F.lower(content))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def gram_table(spark: SparkSession, templates) -> DataFrame:
    """``(hash, template, at, a, b, c)``: the runs of all templates, and the row that carries each document past the join."""
    rows = [(t, at, *words[at:at + GRAM]) for t, _, _, words in templates for at in range(len(words) - GRAM + 1)]
    grams = spark.createDataFrame(rows, "template int, at int, a string, b string, c string")
    own = spark.range(1).select(F.lit(-1).alias("template"), F.lit(0).alias("at"), *[F.lit(None).cast("string").alias(c) for c in "abc"],
                                F.lit(0).cast("long").alias("hash"))
    return grams.withColumn("hash", F.xxhash64("a", "b", "c")).unionByName(own)


def hits(docs: DataFrame, templates, id_column: str = "doc_id") -> DataFrame:
    """``(rid, id, n_words, template, at, diagonal)``, written out: every meeting of a document and a template, and one row with
    template -1 for each document."""
    words = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_column).alias("id"), words_of("text").alias("w"))
    runs = F.transform("w", lambda w, i: F.xxhash64(w, F.get("w", i + 1), F.get("w", i + 2)))
    each = words.select("rid", "id", "w", F.posexplode(F.concat(runs, F.array(F.lit(0).cast("long")))).alias("pos", "hash"))
    same = (F.get("w", F.col("pos")) == F.col("a")) & (F.get("w", F.col("pos") + 1) == F.col("b")) & (F.get("w", F.col("pos") + 2) == F.col("c"))
    own = (F.col("template") == -1) & (F.col("pos") == F.size("w"))
    # a few hundred runs of words, fixed by the templates
    met = each.join(F.broadcast(gram_table(docs.sparkSession, templates)), "hash").where(F.coalesce(same, F.lit(False)) | own)
    return stage(met.select("rid", "id", F.size("w").cast("long").alias("n_words"), "template", "at",
                            (F.col("pos") - F.col("at")).alias("diagonal")), "license-hits")


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, id_column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """What each row of ``docs`` holds, and the spans.

    The first has a row for each row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``. ``n_base`` counts
    the places of ``phrases``; ``score`` is 1 if there is one, else the largest share of a notice that a span covers, else 0.
    The second is ``(rid, id, label, base, first, last, score)``, words from 0, both ends included. Null and empty texts have no
    words. Repeated rows, and rows with equal or null ids, are documents of their own; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    templates = parts(phrases, notices)
    found = hits(docs, templates, id_column)
    known = F.broadcast(spark.createDataFrame([(t, label, base, len(w), (1 << len(w)) - 1) for t, label, base, w in templates],
                                              "template int, label string, base boolean, size int, whole long"))
    # 64 words at most, so one long says which words of the template a diagonal has
    covers = F.expr(f"bit_or(shiftleft({(1 << GRAM) - 1}L, at))")
    diagonals = (found.where("template >= 0").groupBy("rid", "id", "template", "diagonal")
                 .agg(covers.alias("mask"), F.min(F.col("diagonal") + F.col("at")).alias("first"),
                      (F.max(F.col("diagonal") + F.col("at")) + (GRAM - 1)).alias("last")).join(known, "template"))
    places = diagonals.where("base and mask = whole").select("rid", "id", "label", "base", "first", "last", F.lit(1.0).alias("score"))

    line = Window.partitionBy("rid", "template").orderBy("diagonal")
    starts = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= DRIFT, 0).otherwise(1)
    merged = (diagonals.where("not base").withColumn("_new", starts).withColumn("_part", F.sum("_new").over(line))
              .groupBy("rid", "id", "template", "label", "base", "size", "_part")
              .agg(F.expr("bit_count(bit_or(mask))").alias("words"), F.min("first").alias("first"), F.max("last").alias("last"))
              .where((F.col("words") >= F.lit(COVER) * F.col("size")) & (F.col("last") - F.col("first") < F.lit(1.25) * F.col("size") + DRIFT)))
    row = Window.partitionBy("rid").orderBy("first", "last", "template")
    reach = F.max("last").over(row.rowsBetween(Window.unboundedPreceding, -1))
    islands = merged.withColumn("_new", F.when(F.col("first") <= reach, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(row))
    best = F.max_by(F.struct("label", "base", "first", "last", (F.col("words") / F.col("size")).alias("score")),
                    F.struct("words", F.col("words") / F.col("size"), -F.col("template")))
    kept = islands.groupBy("rid", "id", "_island").agg(best.alias("s")).select("rid", "id", "s.*")
    spans = places.unionByName(kept)

    rows = found.where("template = -1").select("rid", "id", "n_words", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("label", "string"), ("base", "boolean"), ("first", "int"), ("score", "double"))])
    both = rows.unionByName(spans.select("rid", "id", F.lit(None).cast("long").alias("n_words"), "label", "base", "first", "score"))

    def joined(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(labels)), ",")  # no more than there are templates
    base = F.col("base")
    out = both.groupBy("rid").agg(
        F.max("id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    return out.drop("rid"), spans


def _sql() -> str:
    templates = parts(PHRASES, NOTICES)
    upper = "".join(map(chr, range(65, 91)))
    values = ", ".join(f"({t}, '{label}', {base}, string_split('{' '.join(words)}', ' '))" for t, label, base, words in templates)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
t(template, label, base, words) AS (VALUES {values}),
g AS (SELECT template, place, list_slice(words, place + 1, place + {GRAM}) AS run FROM (SELECT *, unnest(range(len(words) - {GRAM - 1})) AS place FROM t)),
e AS (SELECT rid, pos, list_slice(w, pos + 1, pos + {GRAM}) AS run FROM (SELECT rid, w, unnest(range(len(w) - {GRAM - 1})) AS pos FROM d)),
h AS (SELECT e.rid, g.template, g.place, e.pos - g.place AS diagonal FROM e JOIN g ON e.run = g.run),
words_met AS (SELECT DISTINCT rid, template, diagonal, place + k AS j FROM h, range({GRAM}) AS r(k)),
diagonals AS (SELECT rid, template, diagonal, count(*) AS n, min(diagonal + j) AS first, max(diagonal + j) AS last
              FROM words_met GROUP BY ALL),
places AS (SELECT rid, label, true AS base, first, last, 1.0 AS score FROM diagonals JOIN t USING (template) WHERE base AND n = len(words)),
lines AS (SELECT rid, template, diagonal, first, last, sum(new) OVER (PARTITION BY rid, template ORDER BY diagonal) AS part FROM (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= {DRIFT} THEN 0 ELSE 1 END AS new
  FROM diagonals JOIN t USING (template) WHERE NOT base)),
merged AS (SELECT l.rid, l.template, l.part, count(DISTINCT m.j) AS words, min(l.first) AS first, max(l.last) AS last
           FROM lines l JOIN words_met m USING (rid, template, diagonal) GROUP BY ALL),
verified AS (SELECT m.*, label, len(t.words) AS size FROM merged m JOIN t USING (template)
             WHERE m.words >= {COVER} * len(t.words) AND last - first < 1.25 * len(t.words) + {DRIFT}),
islands AS (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY first, last, template) AS island FROM (
  SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY rid ORDER BY first, last, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    THEN 0 ELSE 1 END AS new FROM verified)),
best AS (SELECT rid, label, false AS base, first, last, CAST(words AS DOUBLE) / size AS score FROM islands
         QUALIFY row_number() OVER (PARTITION BY rid, island ORDER BY words DESC, CAST(words AS DOUBLE) / size DESC, template) = 1),
spans AS (SELECT * FROM places UNION ALL SELECT * FROM best)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, count(*) FILTER (WHERE s.base) AS n_base,
  CAST(min(s.first) FILTER (WHERE s.base) AS BIGINT) AS first_word, CAST(max(s.first) FILTER (WHERE s.base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT s.label, ',' ORDER BY s.label) FILTER (WHERE s.base), '') AS base_labels,
  coalesce(string_agg(DISTINCT s.label, ',' ORDER BY s.label), '') AS labels, CAST(coalesce(max(s.score), 0) AS DOUBLE) AS score
FROM d LEFT JOIN spans s USING (rid) GROUP BY d.rid, d.doc_id
"""


SQL = _sql()


@query("op12_license_scan", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))[0]
