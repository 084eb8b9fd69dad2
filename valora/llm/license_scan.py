"""License scan with a positional rare-token index.  [native]

Templates are licence notices with mandatory key phrases.  The index maps a
word to its postings (template, offset).  Document frequencies of the licence
words over all documents give their IDF; of every template only the rarest
words are looked up (up to ``RARE``, none with less than half the IDF of the
rarest).  For each document the positions of those words, less their offsets,
are the template's possible starts; the starts that the rare words share are
intersected, and at each one left all key phrases must stand word by word.
The rarest word of a template is one of its key words, so no place is missed.

Everything is done within a document's row by array functions; only the
document frequencies (one row for each licence word) are gathered.

Defined cases: a null text counts as empty; no match gives empty labels, score
0 and null positions; repeated rows are scanned each; a notice may begin
before the text does, as long as its key phrases are inside; columns named like
the added ones keep their names, the added ones get an underscore.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.llm.common import fresh, lower_ascii, read, register

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 2

# Phrases and labels of the contract.
BASE = [
    ("cc-by", "cc by", ["cc by"]),
    ("gpl", "general public license", ["general public license"]),
    ("reserved", "all rights reserved", ["all rights reserved"]),
]
# Public licence notices (label, notice, key phrases).
NOTICES = [
    ("agpl-3.0", "licensed under the gnu affero general public license version 3",
     ["gnu affero general public license", "version 3"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["redistribution and use in source and binary forms"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0 universal"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2",
     ["gnu general public license", "version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     ["gnu general public license", "version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose",
     ["permission to use copy modify and or distribute this software"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy",
     ["permission is hereby granted free of charge"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["free and unencumbered software"]),
]


# the licences' own notices, with and without "either"
NOTICES += [(label, f"terms of the {name} as published by the free software foundation {either}version {n} of the license",
             [f"{name} as published by the free software foundation {either}version {n}"])
            for label, name, n in [("agpl-3.0", "gnu affero general public license", 3),
                                   ("gpl-2.0", "gnu general public license", 2), ("gpl-3.0", "gnu general public license", 3)]
            for either in ("either ", "")]


class Template:
    def __init__(self, label: str, notice: str, phrases: list[str], base: bool):
        self.label, self.base, self.words, self.keys = label, base, notice.split(), []
        for p in phrases:
            p = p.split()
            at = next(i for i in range(len(self.words)) if self.words[i: i + len(p)] == p)
            self.keys.append((at, p))

    def key_words(self) -> list[tuple[str, int]]:
        return [(w, at + i) for at, p in self.keys for i, w in enumerate(p)]

    def rare(self, idf: dict[str, float]) -> list[tuple[str, int]]:
        ranked = sorted(self.key_words(), key=lambda x: (-idf[x[0]], x[1]))
        return [x for x in ranked[:RARE] if idf[x[0]] >= 0.5 * idf[ranked[0][0]]]


TEMPLATES = [Template(*x, base=True) for x in BASE] + [Template(*x, base=False) for x in NOTICES]


def words(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the array of the text's words: what stands between the
    separators, without the empty strings at the two ends."""
    cut = df.withColumn(out, F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), GAP))
    first = F.when(F.col(out)[0] == "", 1).otherwise(0)
    last = F.when((F.size(out) > 1) & (F.element_at(out, -1) == ""), 1).otherwise(0)
    return cut.withColumn(out, F.slice(F.col(out), first + 1, F.size(out) - first - last))


def inverse_frequencies(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """IDF of the licence words; at most as many rows as there are of them."""
    vocabulary = sorted({w for t in TEMPLATES for w, _ in t.key_words()})
    seen = words(docs.select(F.col(text).alias("t")), "t", "ws").select(
        F.explode(F.array_distinct(F.filter("ws", lambda w: w.isin(vocabulary)))).alias("w"))
    n = docs.count()
    df = {r["w"]: r["count"] for r in seen.groupBy("w").count().collect()}
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-9 for w in vocabulary}


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``matches``: for every place of a
    template its label, whether it is a base phrase, its first word and the
    share of the notice's words that stand there."""
    n_words, matches, ws, hits = fresh(docs, "n_words", "matches", "ws", "hits")
    idf = inverse_frequencies(docs, text)
    rare = sorted({w for t in TEMPLATES for w, _ in t.rare(idf)})
    found = F.filter(F.transform(F.col(ws), lambda w, i: F.when(w.isin(rare), F.struct(w.alias("w"), i.alias("i")))),
                     lambda x: x.isNotNull())

    def starts(t: Template) -> Column:
        shared = reduce(F.array_intersect, [
            F.expr(f"transform(filter({hits}, x -> x.w = '{w}'), x -> x.i - {o})") for w, o in t.rare(idf)])
        stands = lambda s: reduce(lambda a, b: a & b, [
            (s + at >= 0) & (F.slice(F.col(ws), F.greatest(s + at, F.lit(0)) + 1, len(p)) == F.array(*map(F.lit, p)))
            for at, p in t.keys])
        return F.filter(shared, stands)

    def places(t: Template) -> Column:
        share = lambda s: reduce(lambda a, b: a + b, [
            F.coalesce((F.get(F.col(ws), s + i) == w).cast("int"), F.lit(0)) for i, w in enumerate(t.words)])
        return F.transform(starts(t), lambda s: F.struct(
            F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), s.cast("long").alias("start"),
            F.lit(1.0).alias("share") if t.base else (share(s) / len(t.words)).alias("share")))

    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,share:double>>")
    return (words(docs, text, ws).withColumn(hits, found)
            .withColumn(matches, F.when(F.size(hits) > 0, F.concat(*map(places, TEMPLATES))).otherwise(none))
            .withColumn(n_words, F.size(ws).cast("long"))
            .select(*docs.columns, n_words, matches))


def _oracle() -> str:
    rows = ", ".join(
        f"({k}, '{t.label}', {str(t.base).lower()}, {i}, '{w}', {str((w, i) in t.key_words()).lower()})"
        for k, t in enumerate(TEMPLATES) for i, w in enumerate(t.words))
    return rf"""
WITH tmpl(t, label, base, off, word, is_key) AS (VALUES {rows}),
need AS (SELECT t, label, base, count(*) AS n, count(*) FILTER (WHERE is_key) AS k FROM tmpl GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM d),
starts AS (SELECT doc_id, t, p - off AS s, count(*) AS k FROM pos JOIN tmpl USING (word) WHERE is_key
  GROUP BY ALL),
good AS (SELECT doc_id, t, s FROM starts JOIN need USING (t, k)),
cover AS (SELECT g.doc_id, g.t, g.s, count(*) AS m FROM good g JOIN tmpl USING (t)
  JOIN pos ON pos.doc_id = g.doc_id AND pos.p = g.s + tmpl.off AND pos.word = tmpl.word GROUP BY ALL),
m AS (SELECT doc_id, s, label, base, CASE WHEN base THEN 1.0::DOUBLE ELSE m::DOUBLE / n END AS share
  FROM cover JOIN need USING (t)),
f AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word,
  max(s) FILTER (WHERE base) AS last_word,
  list_sort(list_distinct(coalesce(list(label) FILTER (WHERE base), []))) AS base_labels,
  list_sort(list_distinct(list(label))) AS labels, max(share) AS score FROM m GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(array_to_string(base_labels, ','), '') AS base_labels,
  coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN f USING (doc_id)"""


@register("op1_license_scan", _oracle())
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("matches", lambda m: m["base"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda m: m["label"]))), ",")
    at = F.transform(base, lambda m: m["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"))
