"""Benchmark decontamination: CGK embedding, bit-sampling LSH, edit check.

A document leaks an item if some stretch of its words is within
``EDIT_SHARE`` (0.2) of the item's words in edit distance.  Words are runs of
letters and digits, A-Z lower-cased.

Embedding.  A CGK walk runs over the words of a window: at step t it gives out
the word it stands on and goes on to the next one or stays, by a random bit
that hangs on t and the word.  Two windows that differ by an insertion or a
deletion fall into step again, so what is near in edit distance is near in
Hamming distance of what the walks give out.
LSH.  A repetition is a walk with bits of its own and a sample of its steps;
windows whose walks give the same words at the sampled steps meet.  An item is
walked from each of its words (the window is the rest of the item) and a
document from every ``stride``-th word, so a leak holds several windows that may
meet, in each of the repetitions.  Stride, steps, sample and repetitions are
chosen by the item's length (``plan``) so that of leaks with the most permitted
edits, int(0.2 n) of n words, at least ``TARGET_RECALL`` are proposed at each
length from 5 words on; tests measure it.  Items of fewer words permit no edit
and are looked up whole.
Check.  What is proposed goes through the exact edit distance.

Items are taken in blocks of at most ``BLOCK_BYTES`` of text, items of equal words
once.  A block's index is broadcast (its size follows from that bound) and
documents are scanned once a block; a larger benchmark means more scans, not a
larger broadcast: with several blocks each one's result is written before the
next index is built.  No document text is shuffled.

Defined cases: null or empty texts leak nothing; items without a word match
nothing; repeated items and rows are reported each; ids may have any type that
Arrow holds; other columns of ``docs`` are ignored by ``find_leaks`` (so names may
clash) and kept by ``drop_leaking``; very long texts are walked like all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructType

from valora.llm.common import read, register
from valora.llm.textops import MULT, mix64, row_groups, text_buffer, word_hashes
from valora.session import stage

EDIT_SHARE = 0.2
TARGET_RECALL = 0.95
BLOCK_BYTES = 8 << 20


class Plan(NamedTuple):
    """``stride``: words between the starts in a document; ``steps`` of a walk,
    of which ``sample`` are taken, at ``least`` that many different places; and
    repetitions.  ``whole``: n words, looked up as they are."""

    stride: int
    steps: int
    sample: int
    least: int
    repeats: int
    whole: int = 0

    def picks(self, r: int) -> list[int]:
        """The sampled steps of a repetition."""
        if self.whole:
            return list(range(self.whole))
        rng = np.random.default_rng(1_000 * self.steps + r)
        return sorted(rng.choice(self.steps, self.sample, replace=False).tolist())


#: smallest item length -> plan
PLANS = {
    5: Plan(1, 5, 3, 2, 12),
    8: Plan(1, 7, 4, 3, 9),
    14: Plan(2, 8, 4, 3, 6),
    24: Plan(4, 8, 4, 3, 6),
}


def plan(n: int) -> Plan:
    """The plan for items of n words."""
    if n < min(PLANS):
        return Plan(1, n, n, n, 1, n)
    return PLANS[max(k for k in PLANS if k <= n)]


@dataclass
class Class:
    """Items of one plan: sorted signatures with their item and the word of it
    that the walk began at, and which heads of signatures occur."""

    plan: Plan
    sigs: np.ndarray
    item: np.ndarray
    place: np.ndarray
    heads: np.ndarray
    shift: np.uint64


@dataclass
class Index:
    """``ids[i]``: the ids of all items with the words ``words[i]``."""

    ids: list
    words: list
    classes: list


def _walks(words: np.ndarray, start: np.ndarray, how: Plan) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each repetition: signatures of the walks from all ``start`` words,
    the last word of each and the number of different places sampled."""
    flat = np.concatenate([words, np.zeros(how.steps + 1, np.uint64)])
    bits = mix64(flat + MULT)
    for r in range(how.repeats):
        at, sig = start.copy(), np.full(len(start), np.uint64(r + 1))
        places, before, picks = np.zeros(len(start), np.int8), np.full(len(start), -1), how.picks(r)
        with np.errstate(over="ignore"):
            for t in range(picks[-1] + 1):
                if t in picks:
                    sig = (sig ^ flat[at]) * MULT
                    sig ^= sig >> np.uint64(29)
                    places += at != before
                    before = at
                if how.whole:
                    at = at + (t < picks[-1])
                elif t < picks[-1]:
                    at = at + (bits[at] >> np.uint64(r * how.steps + t) & np.uint64(1)).astype(np.int64)
        yield mix64(sig), at, places


def build(items: list[tuple[object, str | None]]) -> Index:
    h, ptr = word_hashes(*text_buffer(pa.array([t for _, t in items], pa.string())))
    same: dict[bytes, list] = {}
    for i, (ident, _) in enumerate(items):
        if ptr[i + 1] > ptr[i]:
            same.setdefault(h[ptr[i]: ptr[i + 1]].tobytes(), []).append(ident)
    words = [np.frombuffer(k, np.uint64) for k in same]
    by: dict[Plan, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(plan(len(w)), []).append(i)
    classes = []
    for how, members in sorted(by.items()):
        flat = np.concatenate([words[i] for i in members])
        size = np.array([len(words[i]) for i in members])
        item, end = np.repeat(members, size), np.repeat(np.cumsum(size), size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        found = []
        for sig, last, places in _walks(flat, np.arange(len(flat)), how):
            fits = (last < end) & (places >= how.least)
            found.append((sig[fits], item[fits], place[fits]))
        sig, item, place = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(sig, kind="stable")
        bits = min(24, max(16, len(sig).bit_length() + 4))
        heads, shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
        heads[(sig >> shift).astype(np.int64)] = True
        classes.append(Class(how, sig[order], item[order], place[order], heads, shift))
    return Index(list(same.values()), words, classes)


def edit_distance(item: np.ndarray, part: np.ndarray) -> int:
    """Least edit distance of the item to any stretch of ``part``."""
    j = np.arange(len(part) + 1)
    row = np.zeros(len(part) + 1, np.int64)
    for k, w in enumerate(item):
        nxt = row + 1
        np.minimum(nxt[1:], row[:-1] + (part != w), out=nxt[1:])
        nxt[0] = k + 1
        row = np.minimum.accumulate(nxt - j) + j
    return int(row.min())


def _candidates(words: np.ndarray, ptr: np.ndarray, index: Index) -> Iterator[tuple[int, int, int]]:
    """Distinct (row, item, first word) that some repetition proposes."""
    size = np.diff(ptr)
    inside = np.arange(len(words)) - np.repeat(ptr[:-1], size)
    end = np.repeat(ptr[1:], size)
    for c in index.classes:
        hits = []
        start = np.flatnonzero(inside % c.plan.stride == 0) if c.plan.stride > 1 else np.arange(len(words))
        for sig, last, _ in _walks(words, start, c.plan):
            near = np.flatnonzero(c.heads[(sig >> c.shift).astype(np.int64)])
            near = near[last[near] < end[start[near]]]
            lo = np.searchsorted(c.sigs, sig[near], "left")
            hi = np.searchsorted(c.sigs, sig[near], "right")
            some = hi > lo
            near, lo, hi = near[some], lo[some], hi[some]
            count = hi - lo
            entry = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            pos = np.repeat(start[near], count)
            hits.append(np.column_stack([np.searchsorted(ptr, pos, "right") - 1, c.item[entry], pos - c.place[entry]]))
        if hits:
            yield from map(tuple, np.unique(np.concatenate(hits), axis=0).tolist())


def scan(col, index: Index) -> dict[tuple[int, int], tuple[int, int]]:
    """(row, item): (edits, first word) of the leaks in an Arrow text column;
    of an item's leaks in a row the one with the fewest edits, then the first."""
    buf, off = text_buffer(col)
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for i, j in row_groups(off):
        words, ptr = word_hashes(buf[off[i]: off[j]], off[i: j + 1] - off[i])
        for row, item, start in _candidates(words, ptr, index):
            want = index.words[item]
            n, most = len(want), int(EDIT_SHARE * len(want))
            best = found.get((i + row, item))
            if best and best[0] == 0:
                continue
            lo, hi = int(ptr[row]), int(ptr[row + 1])
            if lo <= start and start + n <= hi and np.array_equal(words[start: start + n], want):
                edits = 0
            else:
                part = words[max(lo, start - most): min(hi, start + n + most)]
                # all but ``most`` of the item's words must be there at all
                if len(set(want.tolist()).difference(part.tolist())) > most:
                    continue
                edits = edit_distance(want, part)
            if edits <= most and (best is None or edits < best[0]):
                found[(i + row, item)] = (edits, max(start - lo, 0))
    return found


def _blocks(benchmark: DataFrame, ident: str, text: str) -> list[DataFrame]:
    """The benchmark in parts of about BLOCK_BYTES / 2 bytes of text."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 16
    total = benchmark.agg(F.sum(size).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) * 2 // BLOCK_BYTES))
    part = F.pmod(F.xxhash64(F.col(text), F.col(ident).cast("string")), F.lit(blocks))
    return [benchmark.where(part == k) for k in range(blocks)] if blocks > 1 else [benchmark]


def _index(part: DataFrame, ident: str, text: str) -> Index:
    items = [(r[0], r[1]) for r in part.select(ident, text).toLocalIterator()]
    return build(sorted(items, key=lambda x: (str(x[0]), x[1] or "")))


def find_leaks(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text",
               item_ident: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, edits, item_words, first_word, similarity), one
    for each document row and item it leaks."""
    item_type = benchmark.schema[item_ident].dataType
    schema = (StructType().add(ident, docs.schema[ident].dataType).add("item_id", item_type)
              .add("edits", LongType()).add("item_words", LongType()).add("first_word", LongType())
              .add("similarity", DoubleType()))
    kinds = [to_arrow_type(item_type), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    parts = _blocks(benchmark, item_ident, item_text)
    found = []
    for part in parts:
        shared = docs.sparkSession.sparkContext.broadcast(_index(part, item_ident, item_text))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                rows = [(row, ident, *best, len(index.words[item])) for (row, item), best in scan(b.column(1), index).items()
                        for ident in index.ids[item]]
                at, items, edits, first, n = zip(*rows) if rows else ((),) * 5
                cols = [items, edits, n, first, [1.0 - e / m for e, m in zip(edits, n)]]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())),
                                                  *(pa.array(c, k) for c, k in zip(cols, kinds))], names=schema.names)

        out = docs.select(ident, text).mapInArrow(run, schema)
        if len(parts) > 1:
            out = stage(out, "leaks")
            shared.unpersist()
        found.append(out)
    return reduce(DataFrame.unionByName, found)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_ident: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that leak an item."""
    at = docs.columns.index(text)
    parts = _blocks(benchmark, item_ident, item_text)
    for part in parts:
        shared = docs.sparkSession.sparkContext.broadcast(_index(part, item_ident, item_text))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[row for row, _ in scan(b.column(at), shared.value)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if len(parts) > 1:
            docs = stage(docs, "not_leaking")
            shared.unpersist()
    return docs


@register("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
