"""Approximate nearest neighbours by multi-index hashing.

Codes: the signs of learned rotations.  ``ROTATIONS`` rotations are each
learned by iterative quantisation (alternately the codes of a sample and the
rotation that fits them best) from starts of their own; together they give
``ROTATIONS * dim`` bits.  Inner product is the measure, so vectors get one
more coordinate that brings all to the length of the longest; for vectors of
equal length it is zero.

Index: a code is split into substrings of ``SUB_BITS`` bits.  In a block of
rows every substring has a directory (its values and the rows of each).  By
the pigeonhole principle a code within Hamming radius R has a substring within
floor(R / substrings); probing goes through the directory's values, so every
code within R is retrieved.  The full distance then decides, and the floats of
what is left are compared in double precision.

The radius is measured on the sample: it holds ``COVER`` of the true
neighbours there; a larger table only has nearer ones.  Where a block has
fewer than k codes within R, its nearest codes count instead, so every query
gets k neighbours.  Queries and rows meet in blocks of bounded size, and a
block returns k rows a query.

Copies: of equal vectors the k + 1 smallest ids are kept on the side of the
candidates (no query can return more, ties go to the smaller id), and equal
queries are searched once.

Defined cases: vectors that are null, empty or zero, hold null or non-finite
numbers, or have another length than most vectors take no part, neither as
queries nor as candidates; rows with the query's own id are left out of its
result; an empty table gives no rows.  The fit reads at most ``FIT_ROWS``
vectors, those with the smallest hash of their id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valora.llm.common import read, register, smallest_hashes
from valora.session import stage

K = 20
ROTATIONS, SUB_BITS, FIT_ROWS, FIT_ROUNDS = 4, 16, 4000, 30
COVER = 0.99
ROW_BLOCK, QUERY_BLOCK = 16_384, 1_024
SEED = 11


def rotations(x: np.ndarray) -> np.ndarray:
    """(bits, dim): learned rotations, one under the other."""
    dim, out = x.shape[1], []
    for r in range(ROTATIONS):
        rot = np.linalg.qr(np.random.default_rng(SEED + r).normal(size=(dim, dim)))[0]
        for _ in range(FIT_ROUNDS):
            u, _, vt = np.linalg.svd(np.where(x @ rot >= 0, 1.0, -1.0).T @ x)
            rot = (u @ vt).T
        out.append(rot.T)
    return np.concatenate(out)


def codes(x: np.ndarray, rot: np.ndarray) -> np.ndarray:
    """Packed codes as 16-bit substrings, padded with zeros."""
    bits = x @ rot.T >= 0
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % SUB_BITS)))
    return np.packbits(bits, axis=1).view(np.uint16)


def lifted(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """The further coordinate that makes all rows as long as the longest; a
    query gets zero."""
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest**2 - np.square(x).sum(axis=1), 0))
    return np.column_stack([x, rest])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def fit(sample: np.ndarray, longest: float, k: int = K) -> tuple[np.ndarray, int]:
    """(rotations, radius)."""
    scale = longest or 1.0
    x = lifted(sample / scale, 1.0, False)
    rot = rotations(x)
    some = slice(0, min(len(sample), 400))
    q = lifted(sample[some] / scale, 1.0, True)
    db, qc = codes(x, rot), codes(q, rot)
    score = (sample[some] @ sample.T)
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    top = np.argsort(-score, axis=1)[:, : min(k, max(len(x) - 1, 1))]
    far = np.concatenate([distance(qc[i], db[top[i]]) for i in range(len(q))])
    return rot, int(np.ceil(np.quantile(far, COVER)))


def directories(db: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every substring its values and the place of each row's value."""
    return [np.unique(db[:, s], return_inverse=True) for s in range(db.shape[1])]


def retrieve(index: list[tuple[np.ndarray, np.ndarray]], qc: np.ndarray, radius: int) -> np.ndarray:
    """Which (query, row) pairs some substring proposes: a mask that holds
    every pair within the radius."""
    within = radius // len(index)
    mask = np.zeros((len(qc), len(index[0][1])), bool)
    for s, (values, rows) in enumerate(index):
        near = np.bitwise_count(qc[:, s][:, None] ^ values[None, :]) <= within
        mask |= near[:, rows]
    return mask


def search_block(db: pd.DataFrame, qs: pd.DataFrame, rot: np.ndarray, radius: int, longest: float, k: int) -> pd.DataFrame:
    """The k nearest of one block of rows for one block of queries."""
    out = {"qid": [], "vec_id": [], "score": []}
    if len(db) and len(qs):
        x, y = np.stack(db["v"]).astype(np.float64), np.stack(qs["v"]).astype(np.float64)
        ids, scale = db["vec_id"].to_numpy(), longest or 1.0
        dc, qc = codes(lifted(x / scale, 1.0, False), rot), codes(lifted(y / scale, 1.0, True), rot)
        index = directories(dc)  # once a block
        for lo in range(0, len(qs), 64):
            part = qc[lo: lo + 64]
            mask = retrieve(index, part, radius)
            for i in range(len(part)):
                rows = np.flatnonzero(mask[i])
                d = distance(part[i], dc[rows])
                rows = rows[d <= radius]
                if len(rows) < k:
                    d = distance(part[i], dc)
                    rows = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
                score = np.concatenate([(x[rows[p: p + 65536]] * y[lo + i]).sum(axis=1) for p in range(0, len(rows), 65536)])
                best = np.lexsort((ids[rows], -score))[:k]
                out["qid"].append(np.full(len(best), qs["qid"].iloc[lo + i]))
                out["vec_id"].append(ids[rows[best]])
                out["score"].append(score[best])
    if not out["qid"]:
        return pd.DataFrame({"qid": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})


def usable(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
        & F.exists(v, lambda x: x != 0)
    good = rows.select(F.col(ident).cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))
    common = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.where(F.size("v") == (common[0]["n"] if common else 0))


def nearest(rows: DataFrame, is_query, k: int = K, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that meets ``is_query``
    (a condition on vec_id) its k nearest other rows."""
    spark = rows.sparkSession
    good = stage(usable(rows, ident, vector), "vectors")
    same = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    db = stage(good.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).select("vec_id", "v"), "ann_rows")
    asked = good.where(is_query)
    groups = stage(asked.groupBy("v").agg(F.min("vec_id").alias("qid")), "ann_queries")
    n, nq = db.count(), groups.count()
    schema = "qid long, vec_id long, score double"
    if n and nq:
        longest = db.select(F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)).alias("l")).agg(F.max("l")).first()[0]
        sample = smallest_hashes(db, ["vec_id"], FIT_ROWS, n).select("v").collect()
        rot, radius = fit(np.array([r["v"] for r in sample]), longest, k)
        shared = spark.sparkContext.broadcast((rot, radius, longest))
        row_blocks, query_blocks = -(-n // ROW_BLOCK), -(-nq // QUERY_BLOCK)
        spread = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        left = db.select(spread("vec_id", row_blocks).alias("rb"), every(query_blocks).alias("qb"), "vec_id", "v")
        right = groups.select(every(row_blocks).alias("rb"), spread("qid", query_blocks).alias("qb"), "qid", "v")

        def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return search_block(a, b, *shared.value, k + 1)

        found = (left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(cell, schema))
    else:
        found = spark.createDataFrame([], schema)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    lists = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    own = (asked.join(groups, "v").select(F.col("vec_id").alias("query_id"), "qid").join(lists.drop("r"), "qid")
           .where(~F.col("vec_id").eqNullSafe(F.col("query_id"))))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return (own.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


@register("op2_nearest_neighbours")
def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
