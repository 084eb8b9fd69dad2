"""SimHash near-duplicates with a pigeonring candidate filter.

Fingerprints: XXH64 (seed 42) of every shingle of a whole text, repeats
included; a bit is 1 if more than half of the hashes have it.  Texts link at
``MAX_BITS`` (3) or fewer differing bits; groups are connected components.

Pigeonring: the 64 bits are a ring of four segments of 16 bits.  If two
fingerprints differ in at most 3 bits, some segment starts a chain whose
cumulative differences stay within the proportional budgets 3/4, 6/4, 9/4 and
3, that is 0, 1, 2 and 3 bits.  The first two links of the chain are the
index key: the starting segment equal, and the next one with at most one
difference, so one of its halves equal: 24 bits in 8 tables.  The longer
chains prune what meets under a key, the full distance decides.

Work: only distinct fingerprints are indexed, so copies cost one row.  What
meets under a key gives a forest (one link per fingerprint), never all pairs.
A key with more than ``GROUP`` fingerprints is refined: the bits it leaves
free are cut into four pieces, of which one must be equal again, and so on
until at most ``FREE_BITS`` bits are free and a group is bounded by itself.
No link is lost at any step.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero and links like any other; a null doc_id takes part and never
names a group that has another id; repeated rows link to each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from valora.llm.common import components, fresh, read, register
from valora.session import stage

SHINGLE, MAX_BITS = 3, 3
GROUP, FREE_BITS = 512, 12
PIECE = 1 << 20
_FULL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in pieces of about ``PIECE`` bytes."""
    pos = 0
    while pos < len(data):
        end = pos + PIECE
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[pos:end].split()
        pos = end


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest
    data = (text or "").encode("utf-8", "replace").lower()
    ones, total, carry, seen = np.zeros(64, np.int64), 0, [], 0
    for words in _words(data):
        words = carry + words
        seen += len(words) - len(carry)
        if len(words) >= n:
            size = np.fromiter(map(len, words), np.int64, len(words))
            stop = np.cumsum(size + 1) - 1
            joined = b" ".join(words)
            hashes = np.array([xxh64_intdigest(joined[s:e], 42) for s, e in
                               zip((stop - size)[: len(words) - n + 1].tolist(), stop[n - 1:].tolist())], np.uint64)
            for p in range(0, len(hashes), 8192):
                bits = np.unpackbits(hashes[p: p + 8192].view(np.uint8).reshape(-1, 8), axis=1)
                ones += bits.sum(axis=0, dtype=np.int64)
            total += len(hashes)
            carry = words[len(words) - n + 1:] if n > 1 else []
        else:
            carry = words
    if not seen:
        return 0
    if seen < n:
        return xxh64_intdigest(b" ".join(carry), 42)
    return int(np.packbits(ones * 2 > total).view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", n: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint as a (signed) long."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), n) for t in b.column(at)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], names=[*b.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(out, LongType()))


def ring_masks() -> list[tuple[int, int]]:
    """(starting segment, mask of the key's bits) of the eight tables."""
    seg = lambda i: 0xFFFF << 16 * (i % 4)
    half = lambda i, k: 0xFF << (16 * (i % 4) + 8 * k)
    return [(i, seg(i) | half(i + 1, k)) for i in range(4) for k in range(2)]


def pieces(mask: int) -> list[int]:
    """The mask with a quarter of its free bits added, in four ways."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = [len(free) * k // 4 for k in range(5)]
    return [mask | sum(1 << b for b in free[cut[k]: cut[k + 1]]) for k in range(4)]


def _forest(ring: np.ndarray, key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Root position of every row: rows of one group (equal ``key``, rows in
    order of it) that link directly or through each other."""
    n = len(fp)
    root = np.arange(n)
    group = np.cumsum(np.concatenate([[0], (np.diff(key) != 0).astype(np.int64)])) if n else root
    left = np.arange(n)
    for d in range(1, n):
        left = left[left + d < n]
        left = left[group[left] == group[left + d]]
        if not len(left):
            break
        i = left[root[left] != root[left + d]]
        j = i + d
        x = fp[i] ^ fp[j]
        for k, budget in ((1, 1), (2, 2), (3, 3)):  # chains of 2, 3 and 4 segments; the first is in the key
            span = np.zeros(4, np.uint64)
            for r in range(4):
                span[r] = sum(0xFFFF << 16 * ((r + s) % 4) for s in range(k + 1))
            ok = np.bitwise_count(x & span[ring[i]]) <= budget
            i, j, x = i[ok], j[ok], x[ok]
        while len(i):  # hook the larger root to the smaller one until nothing changes
            a, b = root[i], root[j]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
            open_ = root[i] != root[j]
            i, j = i[open_], j[open_]
    return root


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ring, mask, key, fp) in order of the first three: a link from
    every fingerprint to the root of its part of the group."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        change = np.any(rows[1:, :3] != rows[:-1, :3], axis=1)
        gid = np.concatenate([[0], np.cumsum(change)])
        fp = rows[:, 3].view(np.uint64)
        root = _forest(rows[:, 0], gid, fp)
        far = root != np.arange(len(root))
        a, b = rows[far, 3], rows[root[far], 3]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64))
        rows = np.concatenate(held)
        same = np.all(rows[:, :3] == rows[-1, :3], axis=1)
        cut = len(rows) - int(same.sum())  # the last group may go on in the next batch
        held = [rows[cut:]]
        if cut:
            yield links(rows[:cut])
    if held and len(held[0]):
        yield links(np.concatenate(held))


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, list[int]] = {}
    for b in batches:
        ring, mask, fp = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
        for m in np.unique(mask).tolist():
            if m not in known:
                known[m] = [_signed(x) for x in pieces(m & _FULL)]
            at = mask == m
            for new in known[m]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ring[at]), pa.array(np.full(int(at.sum()), new, np.int64)), pa.array(fp[at])],
                    names=["ring", "mask", "fp"])


def links(nodes: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between the distinct fingerprints of ``nodes(fp)``
    that connect exactly those that links of at most 3 bits connect."""
    tables = F.array(*[F.struct(F.lit(r).cast("long").alias("ring"), F.lit(_signed(m)).alias("mask"))
                       for r, m in ring_masks()])
    rows = nodes.select("fp", F.explode(tables).alias("t")).select("t.ring", "t.mask", "fp")
    out = None
    for _ in range(8):
        keyed = rows.select("ring", "mask", F.expr("fp & mask").alias("key"), "fp")
        sizes = stage(keyed.groupBy("ring", "mask", "key").count().where("count > 1"), "ring_keys")
        shared = keyed.join(sizes, ["ring", "mask", "key"])
        small = (F.col("count") <= GROUP) | (F.lit(64) - F.bit_count("mask") <= FREE_BITS)
        found = (shared.where(small).select("ring", "mask", "key", "fp")
                 .repartition("ring", "mask", "key").sortWithinPartitions("ring", "mask", "key", "fp")
                 .mapInArrow(_resolve, "a long, b long").distinct())
        found = stage(found, "ring_links")
        out = found if out is None else out.union(found)
        if not sizes.where(~small).limit(1).count():
            return out.distinct()
        rows = stage(shared.where(~small).select("ring", "mask", "fp")
                     .mapInArrow(_refine, "ring long, mask long, fp long").distinct(), "ring_refined")
    raise RuntimeError("a refined key still leaves too many bits free")


def groups(marked: DataFrame, ident: str, fp: str) -> DataFrame:
    """``(fp, component_id, root)`` for the distinct fingerprints of a staged
    table; component_id is the smallest ident of the component."""
    nodes = stage(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(ident).alias("low")), "fps")
    found = components(links(nodes.select("fp")))
    placed = (nodes.join(found, nodes["fp"] == found["node"], "left")
              .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    names = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return placed.select("fp", "root").join(names, "root").select("fp", "component_id", "root")


@register("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    marked = stage(fingerprints(docs).select("doc_id", "fp"), "simhash")
    return (marked.join(groups(marked, "doc_id", "fp").drop("root"), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each group the row with the smallest doc_id stays
    (null last, then the first row read), with all its columns."""
    fp, rid = fresh(docs, "fp", "rid")
    marked = stage(fingerprints(docs, out=fp).withColumn(rid, F.monotonically_increasing_id()), "simhash_docs")
    slim = marked.select(F.col("doc_id"), F.col(fp).alias("fp"), F.col(rid).alias("rid"))
    placed = groups(slim, "doc_id", "fp").select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    kept = slim.join(placed, "fp").groupBy("root").agg(first.alias("k")).select(F.col("k.rid").alias(rid))
    # one join strategy at every size; the small side is a row number each
    return marked.join(stage(kept, "simhash_kept").hint("shuffle_hash"), rid, "left_semi").drop(fp, rid)
