"""License scans by diagonal voting.

All rolling word k-grams of all texts are joined on their hashes with the positions of the license templates' k-grams.
A match votes for the diagonal (text position minus template position); votes are summed for each text, template and
diagonal, neighbouring diagonals (a few words inserted or left out) are merged, and a merged span is verified by the
share of the template's k-grams that it holds and by its length. Templates of up to ``MOST_TEMPLATE_WORDS`` words, such as
the fixed ones, are broadcast, and k-grams of no template are dropped before they become rows, so that nothing but matches
is ever shuffled. Larger sets, whole license bodies say, are a stored table, and the k-grams of the texts are shuffled to
it. Texts are split into words once; what the labels need of them is stored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 4
#: Diagonals this close together, and no further apart than a quarter of the template, belong to one span.
DRIFT = 8
LEAST_COVERAGE = 0.6
#: A span may be this many times as long as its template.
MOST_STRETCH = 1.5
#: More template words than this are no longer broadcast.
MOST_TEMPLATE_WORDS = 200_000

#: The phrases of the base rule and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Standard license notices and their labels.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    ("mit", "Released under the MIT License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "Copyright. All rights reserved"),
)


def words_of(text: Column) -> Column:
    """Runs of other characters than ``NOT_WORD`` after A-Z are lower-cased."""
    return F.array_remove(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def grams_of(words: Column, k: int) -> Column:
    """Hash of each k-gram: the hashes of the words from each place on, folded side by side."""
    hashes = F.transform(words, lambda x: F.xxhash64(x))

    def fold(h: Column) -> Column:
        grams = reduce(lambda g, j: F.zip_with(g, F.slice(h, F.lit(j + 1), F.size(h)), lambda a, b: F.xxhash64(a, b)), range(1, k), h)
        return F.slice(grams, F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(0)))

    return common.let(hashes, fold)


def template_places(spark: SparkSession, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """(template, label, place, gram, grams): each k-gram of each template, and how many the template has."""
    if few_words(templates):
        rows_of = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text")) for i, (label, text) in enumerate(templates)))
        known = spark.range(1).select(F.inline(rows_of))
    else:
        known = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    known = known.select("template", "label", grams_of(words_of(F.col("text")), k).alias("grams"))
    known = known.select("template", "label", F.size("grams").alias("grams"), F.posexplode("grams").alias("place", "gram"))
    return known if few_words(templates) else common.stored(known, "template-grams")


def few_words(templates) -> bool:
    return sum(len(text.split()) for _, text in templates) <= MOST_TEMPLATE_WORDS


def with_votes(rows: DataFrame, places: DataFrame, k: int = GRAM) -> DataFrame:
    """``rows(..., words)`` with hits, the (at, gram) of the k-grams that some template has; for few templates."""
    known = [r.gram for r in places.select("gram").distinct().collect()]  # as bounded as what is broadcast
    hits = F.filter(F.transform(grams_of(F.col("words"), k), lambda g, i: F.when(g.isin(known), F.struct(i.alias("at"), g.alias("gram")))), lambda x: x.isNotNull())
    return rows.select("*", hits.alias("hits"))


def _starts(parts: list[str]):
    return lambda i: reduce(Column.__and__, [F.get("words", i + j) == part for j, part in enumerate(parts)])


def with_phrases(rows: DataFrame, phrases=PHRASES) -> DataFrame:
    """``rows(..., words)`` with n_words, n_base, first_word, last_word and base (array of labels)."""
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    found = []
    for phrase, label in phrases:
        places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), _starts(phrase.split(" ")))
        found.append((F.when(F.col("joined").contains(f" {phrase} "), places).otherwise(F.array().cast("array<int>")), label))
    df = rows.withColumn("joined", joined)
    df = df.select(*rows.columns, *(places.alias(f"places_{i}") for i, (places, _) in enumerate(found)))
    names = [f"places_{i}" for i in range(len(found))]
    labels = F.array_compact(F.array(*(F.when(F.size(n) > 0, F.lit(label)) for n, (_, label) in zip(names, found, strict=True))))
    every = F.concat(*names)
    return df.select(
        *rows.columns,
        F.size("words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        labels.alias("base"),
    )


def template_spans(hits: DataFrame, places: DataFrame, k: int = GRAM, drift: int = DRIFT, least: float = LEAST_COVERAGE, stretch: float = MOST_STRETCH) -> DataFrame:
    """(id, t, label, first, last, coverage) of the verified spans of ``hits(id, t, at, gram)``; positions count words."""
    votes = hits.join(places, "gram").withColumn("diagonal", F.col("at") - F.col("place"))
    lines = votes.groupBy("id", "t", "template", "label", "grams", "diagonal").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("place").alias("places")
    )
    one = Window.partitionBy("id", "t", "template").orderBy("diagonal")
    breaks = F.when(F.col("diagonal") - F.lag("diagonal").over(one) > F.least(F.lit(drift), F.floor(F.col("grams") / 4)), 1).otherwise(0)
    spans = lines.withColumn("breaks", breaks).withColumn("span", F.sum("breaks").over(one.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("id", "t", "template", "label", "grams", "span").agg(
        F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held")
    )
    spans = spans.withColumn("coverage", F.col("held") / F.col("grams"))
    fits = (F.col("coverage") >= least) & (F.col("last") - F.col("first") + 1 <= stretch * (F.col("grams") + k - 1))
    return spans.where(fits).select("id", "t", "label", "first", "last", "coverage")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each row.

    Labels are those of the base phrases and of the verified template spans; spans lists the latter. The score is the
    best coverage of a template, or 1 where a base phrase stands. ``templates`` are (label, text), as many and as long as may
    be; those of fewer than four words have no k-gram and are never found. Null and empty texts have no words, no labels and the
    score 0. Rows that repeat an id are scanned each by its own text; further columns are ignored."""
    places = template_places(docs.sparkSession, templates)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), words_of(F.col(text_col)).alias("words"))
    if few_words(templates):
        based = common.stored(with_phrases(with_votes(rows, places)).drop("words"), "license-votes")
        spans = template_spans(based.where(F.size("hits") > 0).select("id", "t", F.inline("hits")), F.broadcast(places))
    else:
        based = common.stored(with_phrases(rows.withColumn("grams", grams_of(F.col("words"), GRAM))).drop("words"), "license-grams")
        spans = template_spans(based.select("id", "t", F.posexplode("grams").alias("at", "gram")), places)
    spans = spans.groupBy("id", "t").agg(
        F.collect_set("label").alias("more"), F.max("coverage").alias("best"), F.sort_array(F.collect_set(F.struct("first", "last", "label", "coverage"))).alias("spans")
    )
    spans = spans.select(F.col("id").alias("span_id"), F.col("t").alias("span_t"), "more", "best", "spans")
    joined = based.join(spans, F.col("id").eqNullSafe(F.col("span_id")) & (F.col("t") == F.col("span_t")), "left")
    joined = joined.withColumn("more", F.coalesce("more", F.array().cast("array<string>")))
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select(
        "id", "n_words", "n_base", "first_word", "last_word", text(F.col("base")).alias("base_labels"), text(F.concat("base", "more")).alias("labels"), score.alias("score"), "spans"
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op9: phrases, labels and score of every document."""
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
phrase(phrase, label) AS (VALUES {", ".join(f"({_quoted(p)}, {_quoted(label)})" for p, label in PHRASES)}),
base AS (
  SELECT doc_id, i - 1 AS start, label FROM p JOIN phrase
  ON w[i] = string_split(phrase, ' ')[1] AND array_to_string(w[i : i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
bases AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS base FROM base GROUP BY doc_id),
template(template, label, w) AS (
  SELECT template, label, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')
  FROM (VALUES {", ".join(f"({i}, {_quoted(label)}, {_quoted(text)})" for i, (label, text) in enumerate(TEMPLATES))}) AS v(template, label, text)),
known AS (
  SELECT template, label, i - 1 AS place, len(w) - {GRAM - 1} AS grams, array_to_string(w[i : i + {GRAM - 1}], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - {GRAM - 2})) AS i FROM template)),
votes AS (
  SELECT doc_id, template, label, grams, i - 1 AS spot, place, i - 1 - place AS diagonal
  FROM (SELECT doc_id, i, array_to_string(w[i : i + {GRAM - 1}], ' ') AS gram FROM p WHERE i + {GRAM - 1} <= len(w)) JOIN known USING (gram)),
breaks AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > least({DRIFT}, grams // 4) THEN 1 ELSE 0 END AS b
  FROM (SELECT DISTINCT doc_id, template, grams, diagonal FROM votes)),
spans AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM breaks),
held AS (
  SELECT doc_id, template, label, grams, span, min(spot) AS first, max(spot) + {GRAM - 1} AS last, count(DISTINCT place) / grams AS coverage
  FROM votes JOIN (SELECT doc_id, template, diagonal, span FROM spans) USING (doc_id, template, diagonal) GROUP BY doc_id, template, label, grams, span),
fit AS (
  SELECT doc_id, list(DISTINCT label) AS more, max(coverage) AS best FROM held
  WHERE coverage >= {LEAST_COVERAGE}::DOUBLE AND last - first + 1 <= {MOST_STRETCH}::DOUBLE * (grams + {GRAM - 1}) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM w LEFT JOIN bases USING (doc_id) LEFT JOIN fit USING (doc_id)
"""
