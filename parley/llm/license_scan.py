"""Licence phrases in texts, by a positional index of rare words. DataFrame functions only.

Each template, a passage of a licence's notice or body, has a mandatory key phrase; a licence has several. The corpus gives every licence word its document
frequency; a template's postings are the positions of the rarest words of its key phrase. A file's
words that occur in the index are looked up, the template starts that they imply are intersected,
and only there is the key phrase verified and the rest of the template compared. Because the looked
up words belong to the key phrase, no place that holds it can be missed, whatever the frequencies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Everything that ends a word once A-Z are lower-case.
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (label, template, key phrase, is it a base phrase).
TEMPLATES = [
    ("mit", "under the mit license", "under the mit license", True),
    ("apache-2", "apache license version 2", "apache license version 2", True),
    ("cc-by-nc", "cc by nc", "cc by nc", True),
    ("agpl", "gnu affero general public license", "gnu affero general public license", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms", False),
    ("bsd", "bsd 3 clause license", "bsd 3 clause", False),
    ("cc-by-sa", "cc by sa", "cc by sa", False),
    ("cc0", "cc0 1 0 universal", "cc0 1 0", False),
    ("epl", "eclipse public license", "eclipse public license", False),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2", False),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3", False),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute this software", False),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license", False),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "any person obtaining a copy", False),
    ("mpl-2", "mozilla public license version 2 0", "mozilla public license version 2", False),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program", "copy of the gnu affero general public license", False),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "not use this file except in compliance with the license", False),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "unless required by applicable law or agreed to in writing", False),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice", False),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce the above copyright notice", False),
    ("gpl-2", "free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license", False),
    ("gpl-3", "free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license", False),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", "this permission notice appear in all copies", False),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission notice shall be included in all copies or substantial portions", False),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "subject to the terms of the mozilla public license", False),
    ("zlib", "this software is provided as is without any express or implied warranty", "provided as is without any express or implied warranty", False),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software", False),
]
MIN_SHARE = 0.8


def _at(template: str, key: str) -> int:
    words, own = template.split(), key.split()
    return next(i for i in range(len(words)) if words[i : i + len(own)] == own)


def _words(text):
    return F.array_remove(F.split(text, DELIMITERS), "")


def word_frequencies(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Documents in which each licence word occurs; as many entries as there are licence words."""
    vocab = sorted({w for _, t, _, _ in TEMPLATES for w in t.split()})
    own = F.array_intersect(_words(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))), F.array(*map(F.lit, vocab)))
    got = docs.select(F.explode(own).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    return dict.fromkeys(vocab, 0) | {w: n for w, n in got}


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE, places: bool = False) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score[, places]) for every row.

    A place is where a template's key phrase stands and at least ``min_share`` of the template's
    words stand around it as they should. The base columns count the base phrases' places;
    ``labels`` are those of all places; ``score`` is the best share, 0 without a place. Null text is
    empty: no words, no places, empty labels. Null ids stay null, repeated rows each give a row, an
    empty table none; other columns are ignored. A very long text is one row, read whole. Rarity is a word's
    document frequency in the table; the two rarest words of each key phrase are looked up. No shuffle beyond
    the word frequencies. Ids must be numbers.
    """
    seen = word_frequencies(docs, text_col)
    rows = []
    for label, template, key, base in TEMPLATES:
        own = key.split()
        rare = sorted(range(len(own)), key=lambda i: (seen[own[i]], i))[:2]  # the highest IDF
        rows.append((label, template.split(), own, _at(template, key), base, own[rare[0]], rare[0], own[rare[-1]], rare[-1]))
    text = lambda s: "'" + s + "'"  # noqa: E731  phrases hold letters and digits only
    array = lambda ws: f"array({', '.join(map(text, ws))})"
    table = ", ".join(f"named_struct('label', {text(a)}, 'words', {array(b)}, 'key', {array(c)}, 'at', {d}, 'base', {str(e).lower()}, 'w1', {text(f)}, 'q1', {g}, 'w2', {text(h)}, 'q2', {i})" for a, b, c, d, e, f, g, h, i in rows)
    index = array(sorted({w for r in rows for w in (r[5], r[7])}))

    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # full lower-casing gives as many words as that of A-Z and finds at least the same candidates
    first = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("__text"), _words(F.lower(raw)).alias("__w"))
    told = first.select("doc_id", F.size("__w").cast("long").alias("n_words"), F.when(F.arrays_overlap("__w", F.expr(index)), F.col("__text")).alias("__text"))
    exact = told.withColumn("__w", F.when(F.col("__text").isNotNull(), _words(F.translate("__text", UPPER, LOWER))))
    hits = exact.withColumn("__hits", F.expr(f"filter(transform(__w, (x, i) -> named_struct('i', i, 'x', x)), h -> array_contains({index}, h.x))"))
    starts = lambda w, q: f"transform(filter(__hits, h -> h.x = {w}), h -> h.i - {q})"
    found = f"""
        flatten(transform(array({table}), t -> transform(
            filter(array_intersect({starts("t.w1", "t.q1")}, {starts("t.w2", "t.q2")}),
                   s -> s >= 0 and slice(__w, s + 1, size(t.key)) = t.key),
            s -> named_struct('label', t.label, 'base', t.base, 'start', cast(s - t.at as bigint),
                 'share', size(filter(sequence(0, size(t.words) - 1), j -> get(__w, s - t.at + j) = get(t.words, j))) / size(t.words)))))
    """
    placed = hits.withColumn("__p", F.expr(f"filter(coalesce({found}, array()), p -> p.share >= {min_share})"))
    labels = lambda which: F.array_join(F.array_sort(F.array_distinct(F.expr(f"transform(filter(__p, p -> {which}), p -> p.label)"))), ",")
    base = F.expr("transform(filter(__p, p -> p.base), p -> p.start)")
    out = [
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).alias("first_word"), F.array_max(base).alias("last_word"),
        labels("p.base").alias("base_labels"), labels("true").alias("labels"), F.coalesce(F.array_max(F.expr("transform(__p, p -> p.share)")), F.lit(0.0)).cast("double").alias("score"),
    ]
    return placed.select(*out, *([F.col("__p").alias("places")] if places else []))


def oracle() -> str:
    """The same by brute force: every template at every start."""
    values = ", ".join(f"('{label}', string_split('{t}', ' '), string_split('{k}', ' '), {_at(t, k)}, {str(b).lower()})" for label, t, k, b in TEMPLATES)
    return f"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM documents),
    t(label, words, key, key_at, base) AS (VALUES {values}),
    s AS (
      SELECT r, w, unnest(range(len(w))) AS s FROM d),
    k AS (
      SELECT r, w, s, t.* FROM s JOIN t ON s.w[s.s + 1] = t.key[1] WHERE w[s + 1 : s + len(key)] = key),
    p AS (
      SELECT r, label, base, s - key_at AS start,
             len(list_filter(range(len(words)), lambda j: s - key_at + j >= 0 AND w[greatest(s - key_at + j, 0) + 1] = words[j + 1])) / len(words) AS share
      FROM k),
    g AS (
      SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM p WHERE share >= {MIN_SHARE} GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
           CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
    FROM d LEFT JOIN g USING (r)
    """
