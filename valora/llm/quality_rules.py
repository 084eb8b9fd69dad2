"""Quality rules with adaptive thresholds from mergeable sketches.  [native]

Four measures of a text (whole numbers, per 1000) are held against thresholds
that come from the data instead of fixed cutoffs:

word_length  code points of a word, on average    both ends
symbols      ``#*$%&|<>`` for each word           upper end
dup_lines    lines that repeat an earlier one     upper end
repeats      words in repeated 3-word windows     upper end

The sketch of a measure is a log-linear histogram: a value keeps its leading
``BITS`` binary digits, so a bin is at most 1/32 of its value wide and there
are some 30 bins for each doubling.  Sketches merge by adding counts, whatever the
order, so a rerun gives the same thresholds.  They are made per (language,
source) and merged into one per language and one of all.  A source with fewer
than ``MIN_DOCS`` documents takes the thresholds of its language, such a
language those of all, and a table below that has none (all are kept).

With quartiles q1, q3, percentiles p10, p90 and step = 3 * (q3 - q1), a document is
dropped if a measure is above max(p90, q3 + max(step, slack)) or, at the lower
end, below min(p10, q1 - max(step, slack)).  The slack of a measure is the excess
that is no outlier however alike the others are.  Documents that fail the base
rules are dropped as well and don't shape the thresholds.

Everything is done within a document's row by array functions; thresholds are
joined to narrow rows, broadcast while there are at most ``BROADCAST_GROUPS``
groups, and with salted keys beyond, so that one source may hold any share.

Defined cases: a null text has no words and fails the base rules; null language
and source count as the empty string; repeated rows are judged each; columns
named like the added ones keep their names, the added ones get an underscore;
windows are compared by 64-bit hashes, sorted within the row, whatever its
length; an empty table stays empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valora.llm.common import fresh, read, register
from valora.session import stage

MIN_WORDS, MAX_REPEAT = 50, 50
MIN_DOCS = 200
BITS = 6
BROADCAST_GROUPS = 100_000
SALTS = 16
#: measure -> (slack, whether the lower end counts too)
MEASURES = {"word_length": (1000, True), "symbols": (50, False), "dup_lines": (400, False), "repeats": (300, False)}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SPACES = " \t\n\x0b\x0c\r"


def measure(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with the counts of COUNTS, ``n_lines`` (lines with a word) and
    ``base_failed``, and the names that these columns got.  Write the result
    before it is filtered or used twice: a filter pushed into these projections
    makes the arrays again."""
    names = fresh(docs, *COUNTS, "n_lines", "base_failed")
    words, windows, pairs, starts = fresh(docs.select("*", *[F.lit(0).alias(n) for n in names]),
                                          "words", "windows", "pairs", "starts")
    n_words, word_chars, n_symbols, n_dup, n_repeat, n_lines, failed = names
    full = F.coalesce(F.col(text), F.lit(""))
    blank = F.translate(full, SPACES, " " * len(SPACES))
    # one array a projection: what a lambda refers to must be a column, or it is made again for each element
    out = docs.withColumn(words, F.array_remove(F.split(blank, " "), ""))
    out = out.withColumn(windows, F.slice(
        F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
        1, F.greatest(F.size(words) - 2, F.lit(0))))
    lines = F.filter(F.split(full, "\n"), lambda x: F.trim(F.translate(x, SPACES, " " * len(SPACES))) != "")
    none = F.expr("cast(array() as array<struct<h: bigint, i: int>>)")
    out = out.withColumns({
        n_words: F.size(words).cast("long"),
        word_chars: F.char_length(F.translate(full, SPACES, "")).cast("long"),
        n_symbols: (F.char_length(full) - F.char_length(F.translate(full, "#*$%&|<>", ""))).cast("long"),
        n_lines: F.size(lines).cast("long"),
        n_dup: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        pairs: F.when(F.size(F.array_distinct(windows)) < F.size(windows),
                      F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none),
    }).drop(words, windows)
    alike = lambda p, j: (F.get(F.col(pairs), j - 1)["h"] == p["h"]) | (F.get(F.col(pairs), j + 1)["h"] == p["h"])
    out = out.withColumn(starts, F.sort_array(F.transform(F.filter(pairs, alike), lambda p: p["i"]))).drop(pairs)
    # windows at sorted starts cover three words, less what the window before covers
    covered = F.aggregate(starts, F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")), lambda t, x: F.struct(
        x.alias("at"), (t["n"] + F.least(x - t["at"], F.lit(3))).alias("n")), lambda t: t["n"])
    out = out.withColumn(n_repeat, covered).drop(starts)
    fails = (F.col(n_words) < MIN_WORDS) | (100 * F.col(n_repeat) > MAX_REPEAT * F.col(n_words))
    return out.withColumn(failed, fails), names


def binned(value: Column) -> Column:
    """Least value of the bin: the leading BITS binary digits, then zeros."""
    low = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def _measures(names: list[str]) -> dict[str, Column]:
    n_words, word_chars, n_symbols, n_dup, n_repeat, n_lines, _ = (F.col(n) for n in names)
    share = lambda a, n: F.call_function("div", 1000 * a, F.greatest(n, F.lit(1).cast("long")))
    return {"word_length": share(word_chars, n_words), "symbols": share(n_symbols, n_words),
            "dup_lines": share(n_dup, n_lines), "repeats": share(n_repeat, n_words)}


def sketches(measured: DataFrame, names: list[str], lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, m, v, n)``: the histograms of all groups, over the
    documents that pass the base rules.  Add up ``n`` to merge."""
    wanted = [F.struct(F.lit(m).alias("m"), binned(v).alias("v")) for m, v in _measures(names).items()]
    return (measured.where(~F.col(names[-1]))
            .select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
                    F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.inline(F.array(*wanted)))
            .groupBy("lang", "source", "m", "v").agg(F.count(F.lit(1)).alias("n")))


def thresholds(sketch: DataFrame) -> DataFrame:
    """``(lang, source, limits)`` for each group of ``sketch``; limits is a
    struct (low, high) for each measure, null where there is no threshold."""
    sketch = stage(sketch, "rule_sketches")

    def fences(by: list[str]) -> DataFrame:
        merged = sketch.groupBy(*by, "m", "v").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*by, "m")
        up_to = F.sum("n").over(group.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        at = lambda p: F.min(F.when(100 * F.col("to") >= p * F.col("all"), F.col("v")))
        ranked = merged.withColumns({"to": up_to, "all": F.sum("n").over(group)})
        cuts = (ranked.groupBy(*by, "m").agg(*[at(p).alias(f"q{p}") for p in (10, 25, 75, 90)], F.max("all").alias("all"))
                .where(F.col("all") >= MIN_DOCS))
        slack = reduce(lambda e, m: F.when(F.col("m") == m, MEASURES[m][0]).otherwise(e), MEASURES, F.lit(0))
        step = F.greatest(3 * (F.col("q75") - F.col("q25")), slack)
        cuts = cuts.withColumns({"high": F.greatest("q90", F.col("q75") + step), "low": F.least("q10", F.col("q25") - step)})
        one = lambda m, low: F.struct(
            (F.min(F.when(F.col("m") == m, F.col("low"))) if low else F.lit(None).cast("long")).alias("low"),
            F.max(F.when(F.col("m") == m, F.col("high"))).alias("high"))
        return cuts.groupBy(*by).agg(F.struct(*[one(m, low).alias(m) for m, (_, low) in MEASURES.items()]).alias("limits"))

    groups = sketch.select("lang", "source").distinct()
    own, wider = (fences(by).withColumnRenamed("limits", by[-1] + "_limits") for by in (["lang", "source"], ["lang"]))
    overall = fences([]).first()  # one row, none if the table is small
    found = [F.col("source_limits"), F.col("lang_limits")]
    if overall:
        found.append(F.struct(*[F.struct(*[F.lit(end).cast("long").alias(k) for k, end in overall["limits"][m].asDict().items()]).alias(m)
                                for m in MEASURES]))
    return (groups.join(own, ["lang", "source"], "left").join(wider, "lang", "left")
            .select("lang", "source", F.coalesce(*found).alias("limits")))


def judge(measured: DataFrame, names: list[str], limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` with ``kept``."""
    kept, left, right, part, salt = fresh(measured, "kept", "rule_lang", "rule_source", "limits", "salt")
    limits = stage(limits.select(F.col("lang").alias(left), F.col("source").alias(right), F.col("limits").alias(part)),
                   "rule_thresholds")
    rows = measured.withColumns({left: F.coalesce(F.col(lang).cast("string"), F.lit("")),
                                 right: F.coalesce(F.col(source).cast("string"), F.lit(""))})
    if limits.count() <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(limits), [left, right], "left")
    else:
        dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*names, left), F.lit(SALTS)).cast("int"))
        spread = limits.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = dealt.join(spread, [left, right, salt], "left")
    beyond = [F.coalesce(test, F.lit(False)) for m, v in _measures(names).items()
              for test in (binned(v) > F.col(part)[m]["high"], binned(v) < F.col(part)[m]["low"])]
    verdict = ~(F.col(names[-1]) | reduce(lambda a, b: a | b, beyond))
    return joined.withColumn(kept, verdict).select(*measured.columns, kept)


def rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``.  The rows without
    their text are written once and read by both the sketches and the verdict;
    pass only the columns that are wanted back."""
    measured, names = measure(docs, text)
    measured = stage(measured.drop(text), "rule_measures")
    return judge(measured, names, thresholds(sketches(measured, names, lang, source)), lang, source)


_BIN = "({0} >> greatest(length(bin({0})) - 6, 0)) << greatest(length(bin({0})) - 6, 0)"
_SQL_SLACK = "CASE m " + " ".join(f"WHEN '{m}' THEN {s}" for m, (s, _) in MEASURES.items()) + " END"


def _sql_fences(by: str, source: str) -> str:
    """Thresholds of one level, ``by`` a list of columns that ends in a comma."""
    return f"""
  SELECT {by} m, greatest(q90, q75 + greatest(3 * (q75 - q25), {_SQL_SLACK})) AS high,
         CASE WHEN m = 'word_length' THEN least(q10, q25 - greatest(3 * (q75 - q25), {_SQL_SLACK})) END AS low
  FROM (SELECT {by} m, min(v) FILTER (100 * upto >= 10 * total) AS q10, min(v) FILTER (100 * upto >= 25 * total) AS q25,
               min(v) FILTER (100 * upto >= 75 * total) AS q75, min(v) FILTER (100 * upto >= 90 * total) AS q90
        FROM (SELECT {by} m, v, sum(n) OVER (PARTITION BY {by} m ORDER BY v) AS upto,
                     sum(n) OVER (PARTITION BY {by} m) AS total
              FROM (SELECT {by} m, v, count(*) AS n FROM {source} GROUP BY ALL))
        WHERE total >= {MIN_DOCS} GROUP BY ALL)"""


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
windows AS (
  SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS three
  FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
again AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, three) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT row, count(DISTINCT i + d) AS n_repeat_words FROM again, range(0, 3) r(d) GROUP BY row),
counts AS (
  SELECT row, doc_id, lang, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN covered USING (row)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         1000 * word_chars // greatest(n_words, 1) AS a, 1000 * n_symbols // greatest(n_words, 1) AS b,
         1000 * n_dup_lines // greatest(n_lines, 1) AS c, 1000 * n_repeat_words // greatest(n_words, 1) AS d
  FROM counts),
measures AS (
  SELECT row, lang, source, base_failed, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS m,
         unnest([""" + ", ".join(_BIN.format(x) for x in "abcd") + """]) AS v
  FROM judged),
passing AS (SELECT * FROM measures WHERE NOT base_failed),
of_source AS (""" + _sql_fences("lang, source,", "passing") + """),
of_lang AS (""" + _sql_fences("lang,", "passing") + """),
of_all AS (""" + _sql_fences("", "passing") + """),
beyond AS (
  SELECT DISTINCT row
  FROM measures LEFT JOIN of_source s USING (lang, source, m) LEFT JOIN of_lang l USING (lang, m) LEFT JOIN of_all o USING (m)
  WHERE v > coalesce(s.high, l.high, o.high) OR v < coalesce(s.low, l.low, o.low))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND row NOT IN (SELECT row FROM beyond) AS kept
FROM judged"""


@register("op13_quality_rules", ORACLE_SQL)
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rules(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return done.select("doc_id", *COUNTS, "base_failed", "kept")
