"""Distributed Isolation Forest (Liu, Ting & Zhou 2008) for listing outliers.

An MLlib estimator: ``IsolationForest(...).fit(df)`` gives a model that is
saved, loaded and used on other tables; ``isolation_forest`` fits and scores one.

1. Features median-imputed; the medians are kept in the model.
2. Sub-sampling without a full explode: each row joins a tree at a rate that
   gives ~3*psi rows per tree in expectation; one hash of the id decides for
   as many trees as their rates fit into 1.  Per tree the psi rows with the
   smallest rest of the hash are kept (top-k per group, partial before the
   shuffle).  psi = min(256, n).
3. ``groupBy(tree).applyInPandas`` grows one isolation tree per group from
   its psi rows (bounded input, numpy RNG seeded by tree id).
4. The trees (<= 100 x 511 nodes) are collected and shipped to a pandas UDF
   that scores every row: s = 2^(-E[h(x)] / c(psi)).
5. ``is_outlier`` = score above the exact (1 - contamination) percentile of the
   training rows, i.e. the contamination share with the highest scores.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valora.functions import stats as ST
from valora.session import stage

DEFAULT_FEATURES = ["price", "sqft", "bedrooms", "price_per_sqft"]
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size int"


def c_factor(n: float) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(pdf: pd.DataFrame, features: list[str], max_depth: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    rng = np.random.default_rng(1_000_003 * (tree + 1) + 42)
    X = pdf[features].to_numpy(dtype=np.float64)
    rows = []

    def build(idx, depth):
        node = len(rows)
        rows.append([tree, node, -1, 0.0, -1, -1, len(idx)])
        if depth >= max_depth or len(idx) <= 1:
            return node
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.where(hi > lo)[0]
        if len(cand) == 0:
            return node
        f = int(rng.choice(cand))
        thr = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < thr]
        right = idx[sub[:, f] >= thr]
        rows[node][2], rows[node][3] = f, thr
        rows[node][4] = build(left, depth + 1)
        rows[node][5] = build(right, depth + 1)
        return node

    build(np.arange(len(X)), 0)
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size"])


def _path_lengths(trees: list[dict], X: np.ndarray) -> np.ndarray:
    total = np.zeros(X.shape[0])
    for t in trees:
        node = np.zeros(X.shape[0], dtype=np.int64)
        depth = np.zeros(X.shape[0])
        for _ in range(64):
            f = t["feature"][node]
            inner = f >= 0
            if not inner.any():
                break
            xv = X[np.arange(X.shape[0]), np.where(inner, f, 0)]
            nxt = np.where(xv < t["threshold"][node], t["left"][node], t["right"][node])
            node = np.where(inner, nxt, node)
            depth = depth + inner
        total += depth + t["c_leaf"][node]
    return total / len(trees)


def _features_of(df: DataFrame, features: list[str] | None) -> tuple[DataFrame, list[str]]:
    """The frame with ``price_per_sqft`` if it is wanted and can be had, and the
    features that are there."""
    wanted = features or DEFAULT_FEATURES
    if "price_per_sqft" in wanted and "price_per_sqft" not in df.columns and {"price", "sqft"} <= set(df.columns):
        df = df.withColumn("price_per_sqft", F.col("price") / F.nullif(F.col("sqft"), F.lit(0.0)))
    return df, [f for f in wanted if f in df.columns]


class _ForestParams(Params):
    """Parameters shared by the estimator and its model."""

    features = Param(Params._dummy(), "features", "columns used, those that exist", TypeConverters.toListString)
    nTrees = Param(Params._dummy(), "nTrees", "number of trees", TypeConverters.toInt)
    maxSamples = Param(Params._dummy(), "maxSamples", "rows a tree is grown on, at most", TypeConverters.toInt)
    contamination = Param(Params._dummy(), "contamination", "share of training rows above the threshold", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the samples", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "column whose hash draws the samples", TypeConverters.toString)
    scoreCol = Param(Params._dummy(), "scoreCol", "name of the score", TypeConverters.toString)
    outlierCol = Param(Params._dummy(), "outlierCol", "name of the flag", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(features=list(DEFAULT_FEATURES), nTrees=100, maxSamples=256, contamination=0.05, seed=42,
                         idCol="id", scoreCol="anomaly_score", outlierCol="is_outlier")

    def _get(self, name: str):
        return self.getOrDefault(name)


class IsolationForest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """``fit(df)`` grows the trees and sets the threshold on ``df``'s scores."""

    @keyword_only
    def __init__(self, *, features=None, nTrees=100, maxSamples=256, contamination=0.05, seed=42, idCol="id",
                 scoreCol="anomaly_score", outlierCol="is_outlier"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> IsolationForestModel:
        model = self._grown(df)
        if model.medians:
            scores = stage(_features_of(df, self._get("features"))[0].select(model._score(*model._imputed()).alias("s")), "iforest_scores")
            model._set_threshold(scores, "s")
        return model

    def _grown(self, df: DataFrame) -> IsolationForestModel:
        """The model without its threshold."""
        df, feats = _features_of(df, self._get("features"))
        model = self._copyValues(IsolationForestModel())
        if len(feats) < 2:
            return model
        medians = ST.quantiles(df, [], {f: (f, 0.5) for f in feats}).first().asDict()
        model.medians = {f: 0.0 if v is None else v for f, v in medians.items()}
        # the imputed rows feed the count and the samples
        rows = stage(df.select(F.col(self._get("idCol")).alias("id"), *model._imputed()), "iforest_rows")
        n = rows.count()
        model.psi = min(self._get("maxSamples"), n)
        sample = _samples(rows, n, model.psi, self._get("nTrees"), self._get("seed"))
        depth = int(math.ceil(math.log2(max(model.psi, 2))))
        xcols = list(model.medians)
        model.nodes = (sample.groupBy("tree").applyInPandas(lambda p: _grow(p, xcols, depth), NODE_SCHEMA)
                       .toPandas().sort_values(["tree", "node"], ignore_index=True))  # nTrees x (2 * maxSamples - 1) nodes at most
        return model


def _samples(rows: DataFrame, n: int, psi: int, n_trees: int, seed: int) -> DataFrame:
    """The psi rows of each tree, see step 2 of the module's docstring."""
    rate = min(1.0, 3.0 * psi / max(n, 1))
    # one hash serves as many trees as their rates fit into 1: its whole part
    # in units of the rate names the tree, the rest orders the tree's rows
    span = max(1, int(1 / rate))
    draws = -(-n_trees // span)
    u = lambda g: (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), g), F.lit(1 << 40)) /
                   F.lit(float(1 << 40))) / F.lit(rate)
    picks = F.filter(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda g: F.struct(
        (g * span + F.floor(u(g))).cast("int").alias("tree"), (u(g) - F.floor(u(g))).alias("_u"), (u(g) < span).alias("in"))),
        lambda x: x["in"] & (x["tree"] < n_trees))
    drawn = rows.select("*", F.explode(picks).alias("x")).select(*rows.columns, "x.tree", "x._u")
    w = Window.partitionBy("tree").orderBy("_u", "id")
    return drawn.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= psi)


class IsolationForestModel(Model, _ForestParams, MLWritable, MLReadable):
    """Trees, medians for missing values and the threshold of the training
    scores.  ``transform`` scores any table that has the columns; a model
    fitted on fewer than two features flags nothing and gives NULL scores."""

    def __init__(self):
        super().__init__()
        self.medians: dict[str, float] = {}
        self.psi, self.threshold = 0, None
        self.nodes = pd.DataFrame(columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    def trees(self) -> list[dict]:
        out = []
        for _, g in self.nodes.groupby("tree"):
            t = {k: g[k].to_numpy() for k in ("feature", "threshold", "left", "right", "size")}
            t["c_leaf"] = np.array([c_factor(x) for x in t["size"]], dtype=np.float64)  # per node, once
            out.append(t)
        return out

    def _imputed(self) -> list:
        return [F.coalesce(F.col(f).cast("double"), F.lit(m)).alias(f) for f, m in self.medians.items()]

    def _score(self, *cols):
        trees, c_psi = self.trees(), c_factor(self.psi)

        @F.pandas_udf("double")
        def score(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=np.float64) for c in cols])
            return pd.Series(np.power(2.0, -_path_lengths(trees, x) / c_psi))

        return score(*cols)

    def _set_threshold(self, scores: DataFrame, score: str) -> None:
        self.threshold = ST.quantiles(scores, [], {"t": (score, 1.0 - self._get("contamination"))}).first()["t"]

    def _transform(self, df: DataFrame) -> DataFrame:
        score, outlier = self._get("scoreCol"), self._get("outlierCol")
        if not self.medians:
            return df.withColumns({score: F.lit(None).cast("double"), outlier: F.lit(False)})
        df, _ = _features_of(df, self._get("features"))
        return (df.withColumn(score, self._score(*self._imputed()))
                .withColumn(outlier, F.col(score) > F.lit(self.threshold)))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    """Parameters and metadata by MLlib's writer, nodes and medians as Parquet."""

    def __init__(self, model: IsolationForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, spark = self.model, self.sparkSession
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata={"psi": m.psi, "threshold": m.threshold})
        spark.createDataFrame(m.nodes, NODE_SCHEMA).coalesce(1).write.parquet(f"{path}/nodes")
        spark.createDataFrame([(i, f, v) for i, (f, v) in enumerate(m.medians.items())], "i int, feature string, median double") \
            .coalesce(1).write.parquet(f"{path}/medians")


class _ForestReader(MLReader):
    def load(self, path: str) -> IsolationForestModel:
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark)
        model = IsolationForestModel()
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        model.psi, model.threshold = meta["psi"], meta["threshold"]
        model.nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"], ignore_index=True)
        model.medians = {r["feature"]: r["median"] for r in spark.read.parquet(f"{path}/medians").orderBy("i").collect()}
        return model


def isolation_forest(df: DataFrame, features: list[str] | None = None, n_trees: int = 100,
                     max_samples: int = 256, contamination: float = 0.05, seed: int = 42,
                     id_col: str = "id") -> DataFrame:
    """Fit on ``df`` and score it: adds ``anomaly_score`` and ``is_outlier``;
    < 2 usable features -> all False."""
    model = IsolationForest(features=features, nTrees=n_trees, maxSamples=max_samples, contamination=contamination,
                            seed=seed, idCol=id_col)._grown(df)
    scored = model.transform(df)
    if model.medians:  # scores feed the threshold and the output: the trees are walked once per row
        scored = stage(scored.drop("is_outlier"), "iforest_scores")
        model._set_threshold(scored, "anomaly_score")
        scored = scored.withColumn("is_outlier", F.col("anomaly_score") > F.lit(model.threshold))
    return scored
