"""Sharding by histogram sort: shards of near equal bytes, one exchange.

Rows are ordered by a 128-bit key: by default the hash of the text and the
hash of the other columns, so equal texts stand together and yet can be split
where one text holds more than a shard.  For every boundary the exact bytes
below some candidate keys are counted over all rows; the candidates close in
on the boundary until it is within ``TOLERANCE`` of a shard (or no other key
is left between them).  Only then the rows move, once, to their bucket.

A shard consists of buckets of about ``BUCKET_ROWS`` rows and ``BUCKET_BYTES``
bytes at most, whichever makes more of them; their boundaries are found in the same way; a row's slot is its row number in its bucket plus
the rows of the shard's buckets before, so no task sorts a whole shard.  Each
counting pass reads a staged table of keys and sizes and returns one row for
each candidate interval.

Law: ``bytes``.  Size: UTF-8 bytes of the text plus 1.

Defined cases: a null text has size 1 and sorts with its own hash; rows equal
in every column share a key and stay together; an empty table gives no rows;
added columns give way to existing names.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valora.llm.common import fresh, read, register
from valora.session import stage

SHARDS = 8
TOLERANCE, PROBES, BUCKET_ROWS, BUCKET_BYTES = 0.001, 16, 500_000, 256 << 20
_SIGN = np.uint64(1 << 63)


def _keys(h: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Two signed longs as 16 bytes that compare like the pair."""
    both = np.empty((len(h), 2), ">u8")
    both[:, 0] = h.astype(np.int64).view(np.uint64) ^ _SIGN
    both[:, 1] = t.astype(np.int64).view(np.uint64) ^ _SIGN
    return both.view("S16").ravel()


def _packed(keys: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(k.to_bytes(16, "big") for k in keys), "S16")


def histogram(rows: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Bytes, rows, first and last key of the rows between neighbouring
    probes; interval i holds the keys from probe i - 1 up to below probe i."""
    shared = rows.sparkSession.sparkContext.broadcast(_packed(probes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            h, t, size = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            keys = _keys(h, t)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            at = np.searchsorted(shared.value, keys, "right") if len(shared.value) else np.zeros(len(keys), int)
            first = np.flatnonzero(np.diff(at, prepend=-1))
            last = np.append(first[1:], len(at)) - 1
            raw = lambda i: [k.ljust(16, b"\0") for k in keys[i].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[first]), pa.array(np.add.reduceat(size[order], first)), pa.array(last - first + 1),
                 pa.array(raw(first), pa.binary()), pa.array(raw(last), pa.binary())],
                names=["i", "b", "n", "lo", "hi"])

    got = (rows.select("h", "t", "size").mapInArrow(run, "i long, b long, n long, lo binary, hi binary")
           .groupBy("i").agg(F.sum("b"), F.sum("n"), F.min("lo"), F.max("hi")).collect())
    return {r[0]: (r[1], r[2], int.from_bytes(r[3], "big"), int.from_bytes(r[4], "big")) for r in got}


def splitters(rows: DataFrame, buckets: int, tolerance: float) -> list[int]:
    """``buckets - 1`` keys that cut the rows into buckets of equal bytes,
    each within ``tolerance`` bytes or as near as whole keys allow."""
    whole = histogram(rows, [])
    if not whole:
        return []
    total, _, low, high = whole[0]
    # for each boundary: first and last key in question, bytes below the first
    open_ = {j: (low, high, 0, total) for j in range(1, buckets)}
    final: dict[int, int] = {}
    while open_:
        probes = set()
        for lo, hi, _, _ in open_.values():
            probes.update(lo + (hi + 1 - lo) * k // PROBES for k in range(PROBES + 1))
        probes = sorted(probes)
        bins = histogram(rows, probes)
        below, at = [], 0
        for i in range(len(probes) + 1):
            below.append(at)
            at += bins.get(i, (0,))[0]
        edges = np.array(below[1:])  # bytes below each probe
        for j in list(open_):
            goal = total * j / buckets
            i = int(np.searchsorted(edges, goal, "left"))  # the probe interval that holds the goal
            lo_b, hi_b = below[i], at if i == len(probes) else int(edges[i])
            first, last = (bins[i][2], bins[i][3]) if i in bins else (probes[i - 1], probes[i - 1])
            near = min(((abs(goal - lo_b), first), (abs(goal - hi_b), last + 1)))
            if near[0] <= tolerance or first == last:
                final[j] = near[1]
                del open_[j]
            else:
                open_[j] = (first, last, lo_b, hi_b)
    return [final[j] for j in range(1, buckets)]


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", order: list | None = None) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``.  ``order``: two long columns that
    order the rows; by default the hashes of the text and of all columns."""
    h, t, size, bucket, s, slot = fresh(docs, "h", "t", "size", "bucket", "shard", "slot")
    rest = [F.col(c) for c in docs.columns if c != text and "map" not in docs.schema[c].dataType.typeName()]
    first, second = order or (F.xxhash64(text), F.xxhash64(F.lit(0), *rest))
    marked = docs.withColumn(h, first.cast("long")).withColumn(t, second.cast("long"))
    slim = stage(marked.select(F.col(h).alias("h"), F.col(t).alias("t"),
                               (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size")), "shard_keys")
    all_ = slim.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).first()
    fine = max(1, -(-all_["n"] // (shards * BUCKET_ROWS)), -(-(all_["b"] or 0) // (shards * BUCKET_BYTES)))
    cuts = splitters(slim, shards * fine, TOLERANCE * (all_["b"] or 0) / shards)
    counted = histogram(slim, sorted(cuts)) if cuts else {}
    before, offsets = 0, []
    for i in range(shards * fine):
        before = 0 if i % fine == 0 else before
        offsets.append(before)
        before += counted.get(i, (0, 0))[1]
    shared = docs.sparkSession.sparkContext.broadcast(_packed(sorted(cuts)))

    @F.pandas_udf("int")
    def place(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, _keys(a.to_numpy(), b.to_numpy()), "right").astype(np.int32))

    w = Window.partitionBy(bucket).orderBy(h, t)
    placed = marked.withColumn(bucket, place(h, t) if cuts else F.lit(0))
    offset = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col(bucket) + 1) \
        if len(offsets) <= 64 else F.element_at(F.from_json(F.lit(str(offsets)), "array<long>"), F.col(bucket) + 1)
    return placed.select(*docs.columns, F.expr(f"cast({bucket} div {fine} as int)").alias(s),
                         (offset + F.row_number().over(w) - 1).alias(slot))


@register("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit("")).cast("binary")
    return shard(docs).select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def stored_order(docs: DataFrame) -> list | None:
    """File number and row number of a table that Spark has written, else
    None, with a warning: then the default order holds."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        warnings.warn("the rows have no stored order (no _metadata): they are sharded in the order of their hashes", stacklevel=2)
        return None
    return [F.coalesce(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long"), F.lit(0)),
            F.col("_metadata.row_index")]


def in_shards(docs: DataFrame) -> DataFrame:
    """Pipeline stage: shards are runs of the stored (mixed) order."""
    return shard(docs, order=stored_order(docs))
