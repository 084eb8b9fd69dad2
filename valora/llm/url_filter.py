"""URL filter: host and path rules, and boosted trees where no rule fits.

Rules (verdict, host, path prefix) hold for their host and its subdomains; the
longest one that fits wins.  Urls with a rule are the labelled ones: gradient
boosted trees learn from them, on lexical features (lengths, depth, digit
ratio, entropy, parameters, suffix statistics), and judge the others.

Suffix statistics are the smoothed shares of blocked urls by the host's last
label and by the path's first part, hashed into ``SUFFIX_BUCKETS`` buckets,
counted over all labelled urls; so the tables that are broadcast are bounded.
The trees are fitted on the ``FIT_ROWS`` different labelled urls with the
smallest hash, weighted by their numbers of rows.

Defined cases: a null url or one without ``://`` has empty host and path, no
rule and the features of its text; without labelled urls, or with labels of
one kind only, the trees' verdict is that kind, ``allow`` if there is none;
repeated rows are judged alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from valora.llm.common import fresh, lower_ascii, read, register, smallest_hashes

# Rules of the contract (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
FIT_ROWS, TREES, DEPTH, SUFFIX_BUCKETS = 20_000, 12, 3, 4096
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
NUMBERS = ["n_url", "n_host", "n_path", "depth", "labels", "digits", "params", "n_query", "dashes", "fragment",
           "entropy", "tld_rate", "head_rate"]


def rule_of(host: Column, path: Column, rules=None) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    ranked = sorted(rules or RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ranked]
    return F.coalesce(*fits)


@F.pandas_udf(DoubleType())
def entropy(url: pd.Series) -> pd.Series:
    """Bits per byte."""
    def one(u: str | None) -> float:
        if not u:
            return 0.0
        n = np.bincount(np.frombuffer(u.encode("utf-8", "replace"), np.uint8))
        p = n[n > 0] / n.sum()
        return float(-(p * np.log2(p)).sum())
    return url.map(one).astype(float)


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """Numbers of a url's text, its host and its path."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")
    return urls.withColumns({
        "n_url": F.length(u).cast("double"), "n_host": F.length(host).cast("double"), "n_path": F.length(path).cast("double"),
        "depth": count(path, "/"), "labels": count(host, r"\."), "digits": count(u, "[0-9]") / F.greatest(F.length(u), F.lit(1)),
        "params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "n_query": F.length(query).cast("double"),
        "dashes": count(u, "-"), "fragment": u.contains("#").cast("double"), "entropy": entropy(u),
        "tld": F.pmod(F.xxhash64(F.substring_index(host, ".", -1)), F.lit(SUFFIX_BUCKETS)),
        "head": F.pmod(F.xxhash64(F.regexp_extract(path, "^/?([^/]*)", 1)), F.lit(SUFFIX_BUCKETS))})


def judge(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and ``block_score`` (the
    trees' probability of block, null where they weren't fitted)."""
    out = fresh(pages, "host", "path", "rule", "verdict", "block_score")
    keep = {c: f"in_{i}" for i, c in enumerate(pages.columns)}
    u = pages.select(*[F.col(c).alias(k) for c, k in keep.items()]).withColumn("url", F.col(keep[url]))
    u = (u.withColumn("host", lower_ascii(F.coalesce(F.regexp_extract("url", PARTS, 1), F.lit(""))))
         .withColumn("path", F.coalesce(F.regexp_extract("url", PARTS, 2), F.lit(""))))
    u = u.withColumn("r", rule_of(F.col("host"), F.col("path")))
    full = lexical(u).withColumn("label", F.when(F.col("r").isNotNull(), (F.col("r.verdict") == "block").cast("double")))
    slim = full.select("url", "label", *NUMBERS[:-2], "tld", "head").where("label is not null")
    base = slim.agg(F.avg("label").alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi"),
                    F.approx_count_distinct("url").alias("n")).first()  # for a cut with room
    if base["p"] is None or base["lo"] == base["hi"]:
        kind = "block" if base["p"] == 1 else "allow"
        verdict, score = F.coalesce("r.verdict", F.lit(kind)), F.lit(None).cast("double")
    else:
        def rated(df: DataFrame) -> DataFrame:
            for c in ("tld", "head"):  # at most SUFFIX_BUCKETS rows
                rate = slim.groupBy(c).agg(((F.sum("label") + 2 * base["p"]) / (F.count("label") + 2)).alias(f"{c}_rate"))
                df = df.join(F.broadcast(rate), c, "left").fillna({f"{c}_rate": base["p"]})
            return df
        pack = VectorAssembler(inputCols=NUMBERS, outputCol="features")
        # a url's features and label follow from its text
        urls = u.where("r is not null").groupBy("url", "host", "path", "r").agg(F.count(F.lit(1)).cast("double").alias("rows"))
        sample = rated(lexical(smallest_hashes(urls, ["url"], FIT_ROWS, base["n"]))
                       .withColumn("label", (F.col("r.verdict") == "block").cast("double")))
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, featuresCol="features", labelCol="label",
                              weightCol="rows").fit(
            pack.transform(sample).select("features", "label", "rows").coalesce(4).cache())
        full = trees.transform(pack.transform(rated(full)))
        score = vector_to_array("probability")[1]
        verdict = F.coalesce("r.verdict", F.when(score >= 0.5, "block").otherwise("allow"))
    return full.select(*[F.col(k).alias(c) for c, k in keep.items()], F.col("host").alias(out[0]), F.col("path").alias(out[1]),
                       F.col("r.rule").alias(out[2]), verdict.alias(out[3]), score.alias(out[4]))


@register("op7_url_filter")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).drop("url")
