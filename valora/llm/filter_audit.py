"""Audit of how filters interact, on count-weighted decision diagrams.

Every document has a failure mask: bit i is set if filter i would drop it.
Masks are counted per part in Spark (partial sums; a part is at most 2^k rows
however many documents it has).  For each part a decision diagram is built:
level = filter, low edge = passes, high edge = fails, and every node carries
the sums (documents, good, toxic) of the masks below it.  Equal nodes of a
level are one node, and nothing stands below a sum of zero.

Swapping two adjacent levels changes only those two: the grandchildren of a
node are regrouped, its own sum and all levels above stay.  The orders are
visited so that each differs from the last by one such swap.  In any order the
path of low edges from the root is what is left after each step; the high edge
beside it is what the step removes.

Filters of ``failures`` (words: runs without ASCII white space):

A  fewer than 200 words            B  100 * different words < 50 * words
C  100 * [A-Z] > 3 * code points   D  holds any of ``#$%&*|``
E  same text as a smaller id, anywhere in the table

Defined cases: a null text counts as empty; a null part is the empty string;
null ids have no smaller one and pass E; rows that share an id and a text
don't fail E for each other; labels that repeat an id count once, a 1 among
them wins; documents without labels are neither good nor toxic; an empty table
gives no rows; other columns are ignored; a very long text is read in slices,
what is held of it are its different words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.llm.common import read, register
from valora.session import stage

FILTERS = "ABCDE"
SLICE = 1 << 20
_SYMBOLS = re.compile(rb"[#$%&*|]")
_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(128, 192))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# ------------------------------------------------------------------ diagrams

class Diagram:
    """Count-weighted decision diagram over ``variables`` (top level first).

    ``nodes[id] = [low, high]``, both ids of the next level; ``sums[id]``.
    Node 0 is the empty one: no document is below it.
    """

    def __init__(self, variables: str, weights: dict[int, tuple[int, ...]]):
        self.order, self.last = list(range(len(variables))), 0
        self.width = len(next(iter(weights.values()))) if weights else 1
        self.zero = (0,) * self.width
        self.sums, self.nodes, self.levels = {0: self.zero}, {}, [{} for _ in variables]
        self.leaves: dict[tuple[int, ...], int] = {self.zero: 0}
        self.root = self._build(0, 0, weights)

    def _new(self, total: tuple[int, ...]) -> int:
        self.last += 1
        self.sums[self.last] = total
        return self.last

    def _build(self, level: int, mask: int, weights: dict) -> int:
        if level == len(self.order):
            total = weights.get(mask, self.zero)
            if total not in self.leaves:
                self.leaves[total] = self._new(total)
            return self.leaves[total]
        low = self._build(level + 1, mask, weights)
        return self._node(level, low, self._build(level + 1, mask | 1 << self.order[level], weights))

    def _node(self, level: int, low: int, high: int) -> int:
        if not low and not high:
            return 0
        table = self.levels[level]
        if (low, high) not in table:
            name = table[low, high] = self._new(tuple(a + b for a, b in zip(self.sums[low], self.sums[high])))
            self.nodes[name] = (low, high)
        return table[low, high]

    def swap(self, level: int) -> None:
        """Exchange the variables of ``level`` and the one below it."""
        upper, self.levels[level], self.levels[level + 1] = self.levels[level], {}, {}
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        for (low, high), name in upper.items():
            (f00, f01), (f10, f11) = self.nodes.get(low, (0, 0)), self.nodes.get(high, (0, 0))
            edges = self._node(level + 1, f00, f10), self._node(level + 1, f01, f11)
            self.nodes[name], self.levels[level][edges] = edges, name

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(variable, sums kept, sums removed) down the all-pass path."""
        at = self.root
        for variable in self.order:
            low, high = self.nodes.get(at, (0, 0))
            yield variable, self.sums[low], self.sums[high]
            at = low


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap so that all n! orders are visited, each once: the last
    element runs through the orders of the others, back and forth."""
    if n < 2:
        return
    inner, down = adjacent_swaps(n - 1), True
    while True:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        step = next(inner, None)
        if step is None:
            return
        yield step + (1 if down else 0)  # the runner stands before or behind the others
        down = not down


AUDIT = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
         "unique_fails long, good_lost long, toxic_lost long, shapley long")


def audit_part(filters: str, masks: list[dict]) -> list[tuple]:
    """Rows (without the part) of all orders of ``filters``."""
    weights = {r["mask"]: (r["n"], r["good"], r["toxic"]) for r in masks}
    fails = [sum(w[0] for m, w in weights.items() if m >> i & 1) for i in range(len(filters))]
    alone = [weights.get(1 << i, (0,))[0] for i in range(len(filters))]
    diagram, rows, shapley = Diagram(filters, weights), [], [0] * len(filters)

    def walk() -> None:
        name = "".join(filters[i] for i in diagram.order)
        for k, (i, kept, removed) in enumerate(diagram.steps(), 1):
            shapley[i] += removed[0]
            rows.append((name, k, kept[0], removed[0], fails[i] - removed[0], alone[i], removed[1], removed[2], i))

    walk()
    for level in adjacent_swaps(len(filters)):
        diagram.swap(level)
        walk()
    return [(*r[:-1], shapley[r[-1]]) for r in rows]


def audit(docs: DataFrame, part: Column, mask: Column, good: Column, toxic: Column,
          n: Column | None = None, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of ``filters`` and step.  ``mask``: bit i is
    set if filter i would drop the document; ``good``, ``toxic``: boolean;
    ``n``: how many documents the row stands for (one if not given)."""
    n = F.lit(1) if n is None else n
    counted = (docs.select(F.coalesce(part, F.lit("")).alias("part"), mask.cast("long").alias("mask"), n.cast("long").alias("n"),
                           F.when(good, n).otherwise(0).alias("good"), F.when(toxic, n).otherwise(0).alias("toxic"))
               .groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
               .groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks")))
    names = [c.split()[0] for c in AUDIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, masks in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cols = list(zip(*audit_part(filters, masks)))
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cols[0]), pa.string()),
                                                  *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)

    return counted.mapInArrow(run, AUDIT)


# ------------------------------------------------------------------ the five filters

def slices(data: bytes) -> Iterator[bytes]:
    """The text in pieces of about SLICE bytes that end at white space."""
    at = 0
    while len(data) - at > SLICE:
        cut = _SPACE.search(data, at + SLICE)
        if cut is None:
            break
        yield data[at: cut.end()]
        at = cut.end()
    yield data[at:] if at else data


def text_mask(data: bytes) -> int:
    """Bits 0 to 3: the filters A to D fail this text."""
    words, seen = 0, set()
    for part in slices(data):
        found = part.split()  # bytes: splits at ASCII white space alone
        words += len(found)
        seen.update(found)
    points = len(data.translate(None, _CONTINUED))
    upper = len(data) - len(data.translate(None, _UPPER))
    return ((words < 200) | (100 * len(seen) < 50 * words) << 1 | (100 * upper > 3 * points) << 2
            | (_SYMBOLS.search(data) is not None) << 3)


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(part, mask, good, toxic, n)``, where n documents are alike.

    Equal texts are found by their SHA-256.  No step gathers the copies of a
    text: the smallest id of each is a partial minimum, and the join that finds
    the rows which hold it has the id in its key.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks = [text_mask(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(3).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(masks, pa.int32())], names=["id", "part", "h", "mask"])

    full = F.coalesce(F.col(text), F.lit(""))
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = (docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                        F.unhex(F.sha2(full, 256)).alias("h"), full.alias("text"))
            .mapInArrow(run, f"id {id_type}, part string, h binary, mask int")
            .groupBy("id", "part", "h", "mask").agg(F.count(F.lit(1)).alias("n")))
    rows = stage(rows, "audit_rows")
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"),
                                                           F.max(F.col("toxic") == 1).alias("toxic"))
    first = rows.groupBy("h").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.col("first").isNull() & F.col("id").isNotNull()
    return (rows.join(first, ["h", "id"], "left").join(known, "id", "left")
            .select("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"),
                    F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents),
known AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(k.good, false) AS good, coalesce(k.toxic, false) AS toxic,
         (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM words LEFT JOIN known k USING (doc_id)),
counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM masks GROUP BY ALL),
f(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
  SELECT filter_order, s AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS earlier
  FROM orders, range(1, 6) r(s)),
done AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & earlier > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM done"""


@register("op12_filter_audit", ORACLE_SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = failures(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return audit(masks, F.col("part"), F.col("mask"), F.col("good"), F.col("toxic"), F.col("n"))
