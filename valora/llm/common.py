"""Spark helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.session import stage
from valora.sources.tables import table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        REGISTRY[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, made from the wanted ones."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def lower_ascii(col):
    """A-Z to a-z, every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def smallest_hashes(df: DataFrame, key, rows: int, total: int) -> DataFrame:
    """About the ``rows`` rows of ``total`` whose hash of ``key`` is smallest,
    at most ``rows``.  A cut at twice the wanted share comes first, so that
    what is sorted doesn't grow with the number of partitions."""
    h = F.xxhash64(*key)
    share = min(1.0, 2 * rows / max(total, 1))
    return df.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy(F.pmod(h, F.lit(1 << 30)), *key).limit(rows)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs of any kind): rows
    ``(node, root)``, root the smallest node of the component.

    Alternates the large-star and small-star steps: every round links the
    neighbours of a node to the smallest of them; both are a partial ``min``
    per node and one join on the node, which AQE splits where one node holds
    many edges.  Each round is staged as a table, so that neither lineage nor
    lost executors matter.  Needs O(log n) rounds.
    """
    e = stage(edges.select("a", "b").where("a <> b").distinct(), "cc")
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours move to the smallest of the neighbourhood
        large = (both.join(low, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: the smaller neighbours and the node itself move
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(small_low, "a")
        small = (linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(small_low.select("a", F.col("m").alias("b")))
                 .where("a <> b").distinct())
        nxt = stage(small, "cc")
        # finished once every node hangs on one root that hangs on nothing
        roots = nxt.select(F.col("b").alias("x")).distinct()
        loose = nxt.join(roots, nxt["a"] == roots["x"], "left_semi").limit(1).count()
        many = nxt.groupBy("a").count().where("count > 1").limit(1).count()
        e = nxt
        if not loose and not many:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
