"""Mixing sources to target weights by Pfair scheduling.  [native]

The documents of a source form blocks of ``BLOCK_ROWS``.  The target is the
fluid mix, in which every source is served at its exact weight over the sum of
the weights of the sources that still have blocks.  Block i of a source may run
from the slot in which its fluid service begins (its release) and must run
before the slot in which it has ended (its deadline), so floor(i / w) and
ceil((i + 1) / w) while all sources last.  Every slot takes the released block
with the earliest deadline.  The fluid mix itself keeps all these limits, one
block a slot, so the earliest deadline does too, and after any number of slots
a source is less than one block away from its exact share.

Fluid time: at virtual time v a source of weight w and n blocks has got
min(w v, n), so block i begins at v = i / w, in slot sum(min(w v, n)) over all
sources.  Weights are integers (the given decimals, scaled), and slots are
taken by integer division, so nothing is rounded.

The plan is made on the driver, ``PIECE`` blocks of a source to a row (a number
for each block, in steps of ``STEP`` blocks), and staged as a table; it is
broadcast up to ``BROADCAST_BLOCKS`` blocks and joined beyond.  There may be any
number of sources; ``MAX_SOURCES`` can be set to refuse more.  Documents move
by DataFrame functions only: their number in their source is a row number in a
chunk (by hash of id and text) plus the count of the chunks before, so that no
source is a window by itself.

Without weights a source gets the square root of its number of documents.

Defined cases: a null source is a source of its own; sources without a
positive weight come after all others, in equal parts; ties of deadlines go to
the source that comes first in order of name; an empty table gives no rows;
repeated rows are scheduled each; added columns give way to existing names.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valora.llm.common import fresh, read, register
from valora.session import stage

#: refuse more sources than this; None: any number
MAX_SOURCES: int | None = None
RESOLUTION, BLOCK_ROWS = 1000, 8
#: blocks in a row of the plan, blocks planned before rows are handed on, and
#: blocks up to which the plan is broadcast (8 bytes each)
PIECE, STEP, BROADCAST_BLOCKS = 4096, 2_000_000, 4_000_000
CHUNK_ROWS, MIN_CHUNKS = 100_000, 64


def parts(weights: dict[str, float]) -> dict[str, int]:
    """Whole parts of RESOLUTION by largest remainder, one at least (for shares
    that are wanted as such; the schedule takes the exact weights)."""
    total = sum(weights.values())
    exact = {k: v / total * RESOLUTION for k, v in weights.items()}
    out = {k: max(1, math.floor(x)) for k, x in exact.items()}
    by_need = sorted(exact, key=lambda k: (out[k] - exact[k], k))
    for i in range(max(0, RESOLUTION - sum(out.values()))):
        out[by_need[i % len(by_need)]] += 1
    while sum(out.values()) > RESOLUTION:
        out[max(out, key=lambda k: (out[k], k))] -= 1
    return out


def whole(weights: dict[str, float]) -> dict[str, int]:
    """The weights as integers in the same proportions, exactly those of the
    decimal numbers as written."""
    exact = {k: Fraction(repr(float(w))) for k, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    return {k: int(x * scale) for k, x in exact.items()}


def _fluid(blocks: dict[str, int], weights: dict[str, int]):
    """Function of (weight, number of blocks i) to the fluid mix's time at
    virtual time i / weight as (whole slots, whether there is a rest)."""
    ends = sorted({(Fraction(blocks[k], weights[k])) for k in blocks})
    at = {v: j for j, v in enumerate(ends)}
    done, gone = [0] * (len(ends) + 1), [0] * (len(ends) + 1)
    for k, n in blocks.items():
        j = at[Fraction(n, weights[k])] + 1
        done[j] += n
        gone[j] += weights[k]
    rate = [sum(weights[k] for k in blocks)] + [0] * len(ends)
    for j in range(1, len(done)):
        done[j] += done[j - 1]
        rate[j] = rate[j - 1] - gone[j]
    near = [float(v) for v in ends]
    pair = [(v.numerator, v.denominator) for v in ends]

    def time(w: int, i: int) -> tuple[int, bool]:
        j = bisect_right(near, i / w)  # nearly right; made exact
        while j < len(pair) and i * pair[j][1] >= pair[j][0] * w:
            j += 1
        while j and i * pair[j - 1][1] < pair[j - 1][0] * w:
            j -= 1
        slot, rest = divmod(rate[j] * i, w)
        return done[j] + slot, rest > 0
    return time


def schedule(blocks: dict[str, int], weights: dict[str, int]) -> Iterator[str]:
    """The source of every slot, earliest deadline first among the released
    blocks, for positive integer weights."""
    time = _fluid(blocks, weights)
    names = sorted(blocks)
    waiting = [(0, j, 0) for j in range(len(names)) if blocks[names[j]]]  # (release, source, block)
    ready: list[tuple[int, int, int, int]] = []  # (deadline, source, block, next release)
    for t in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= t:
            _, j, i = heapq.heappop(waiting)
            slot, rest = time(weights[names[j]], i + 1)
            heapq.heappush(ready, (slot + rest, j, i, slot))
        deadline, j, i, after = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        if i + 1 < blocks[names[j]]:
            heapq.heappush(waiting, (after, j, i + 1))
        yield names[j]


def period(share: dict[str, int]) -> dict[str, list[int]]:
    """Slots of every source in one period of whole shares."""
    slots: dict[str, list[int]] = {k: [] for k in share}
    for t, k in enumerate(schedule(share, share)):
        slots[k].append(t)
    return slots


def stream(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[str]:
    """The source of every slot; those without a positive weight come last."""
    first = {k: weights[k] for k in blocks if weights.get(k, 0) > 0}
    for some in (first, {k: 1.0 for k in blocks if k not in first}):
        if some:
            yield from schedule({k: blocks[k] for k in some}, whole(some))


def pieces(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, list[int]]]:
    """The plan: rows (source, piece, slots of the piece's blocks)."""
    open_: dict[str, tuple[int, list[int]]] = {}
    for t, k in enumerate(stream(blocks, weights)):
        n, slots = open_.get(k) or open_.setdefault(k, (0, []))
        slots.append(t)
        if len(slots) == PIECE:
            yield k, n, slots
            open_[k] = (n + 1, [])
    yield from ((k, n, slots) for k, (n, slots) in open_.items() if slots)


def phases(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, list[tuple]]:
    """For each source (first block, end, first slot, period, slots): the whole
    schedule as one run."""
    slots: dict[str, list[int]] = {k: [] for k in blocks}
    for t, k in enumerate(stream(blocks, weights)):
        slots[k].append(t)
    return {k: [(0, len(x), 0, sum(blocks.values()), x)] for k, x in slots.items()}


def _table(spark: SparkSession, blocks: dict[str, int], weights: dict[str, float], kind: str) -> DataFrame:
    """The plan as a DataFrame; a large one is staged in parts."""
    parts_, rows, n = [], [], 0
    for row in pieces(blocks, weights):
        rows.append(row)
        n += len(row[2])
        if n >= STEP:
            parts_.append(stage(spark.createDataFrame(rows, kind), "mix_plan"))
            rows, n = [], 0
    if rows or not parts_:
        parts_.append(spark.createDataFrame(rows, kind))
    return reduce(DataFrame.unionByName, parts_)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source",
        ident: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with ``mix_block`` (of its source), ``mix_slot`` (its block's
    slot, gapless) and ``mix_item`` (place in the block)."""
    names = fresh(docs, "mix_block", "mix_slot", "mix_item", "sk", "chunk", "cnt", "before", "plan", "piece", "k")
    block, slot, item, sk, chunk, cnt, before, plan, piece, k = names
    key = F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source).cast("string")))
    sizes = docs.groupBy(key.alias(sk)).count()
    sizes = (sizes if MAX_SOURCES is None else sizes.limit(MAX_SOURCES + 1)).collect()
    if MAX_SOURCES is not None and len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = {r[sk]: r["count"] for r in sizes}
    if weights is None:
        target = {s: math.sqrt(n) for s, n in rows.items()}
    else:
        target = {"0" if s is None else f"1{s}": float(w) for s, w in weights.items()}
    blocks = {s: -(-n // block_rows) for s, n in sorted(rows.items())}
    table = _table(docs.sparkSession, blocks, target, f"{sk} string, {piece} bigint, {plan} array<bigint>")
    if sum(blocks.values()) <= BROADCAST_BLOCKS:
        table = F.broadcast(table)

    chunks = max(MIN_CHUNKS, -(-sum(rows.values()) // CHUNK_ROWS))
    hashed = F.xxhash64(F.col(ident), F.col(text))
    marked = docs.withColumn(sk, key).withColumn(chunk, F.pmod(hashed, F.lit(chunks)))
    earlier = Window.partitionBy(sk).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (marked.groupBy(sk, chunk).agg(F.count(F.lit(1)).alias(cnt))
               .withColumn(before, F.coalesce(F.sum(cnt).over(earlier), F.lit(0))).drop(cnt))
    inside = Window.partitionBy(sk, chunk).orderBy(hashed, ident, text)
    numbered = (marked.withColumn(k, F.row_number().over(inside) - 1)
                .join(offsets, [sk, chunk])
                .withColumn(k, F.col(k) + F.col(before))
                .withColumn(block, F.expr(f"{k} div {block_rows}"))
                .withColumn(item, (F.col(k) % block_rows).cast("int")))
    placed = numbered.withColumn(piece, F.expr(f"{block} div {PIECE}")).join(table, [sk, piece])
    at = F.element_at(F.col(plan), (F.col(block) % PIECE + 1).cast("int"))
    return placed.withColumn(slot, at).select(*docs.columns, block, slot, item)


@register("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "mix_block", "mix_slot", "mix_item")


def in_order(docs: DataFrame) -> DataFrame:
    """Pipeline stage: all documents, stored in the order of the mix."""
    mixed = mix(docs)
    slot, item = mixed.columns[-2:]
    return mixed.orderBy(slot, item).select(*docs.columns)
