"""Price model: split, train (MLlib GBT), predict, metrics, importance,
tuning, persistence, run log, invariance checks, scenarios.

MLlib's GBTRegressor replaces the original gradient-boosted library; the
parameter mapping is n_estimators -> maxIter, max_depth -> maxDepth,
learning_rate -> stepSize, subsample -> subsamplingRate, min_child_weight ->
minInstancesPerNode, colsample_bytree -> featureSubsetStrategy.  Missing
values must be imputed upstream (``handleInvalid='error'``).  On large tables
``boost`` grows the same trees in other passes over the rows.
"""

from __future__ import annotations

import json
import math
import random
import time
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valora import params as P
from valora.operators import boost as BO
from valora.operators import features as FE
from valora.operators import metrics as MT
from valora.operators import quality as QU
from valora.operators import spatial as SP
from valora.session import stage


def feature_table(listings: DataFrame, feature_year: int = P.FEATURE_YEAR) -> DataFrame:
    """listings -> imputed V3 feature table (V2.2 features + spatial lags).

    The rows are written with their cell first: imputation reads them three
    times, and the cell's formula in one generated method with the joins and
    distances costs several times what it costs alone."""
    rows = listings if "h3_index" in listings.columns else SP.add_cell_index(listings)
    df = QU.impute_condition(QU.impute_sqft(stage(rows, "feature_rows")))
    df = FE.add_v2_features(df, feature_year)
    return SP.spatial_lags(df)


def split(df: DataFrame, test_pct: int = 20, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Deterministic 80/20 split from the id: ``(id*7919 + seed) mod 100``.
    Stable under repartitioning and re-execution (unlike ``randomSplit``)."""
    b = F.pmod(F.col(id_col) * 7919 + seed, F.lit(100))
    return df.withColumn("is_test", b < test_pct)


def _gbt(params: dict) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features", labelCol=P.TARGET,
        maxIter=int(params.get("n_estimators", 100)), maxDepth=int(params.get("max_depth", 6)),
        stepSize=float(params.get("learning_rate", 0.1)), seed=int(params.get("seed", 42)),
        subsamplingRate=float(params.get("subsample", 1.0)),
        minInstancesPerNode=int(params.get("min_child_weight", 1)),
        featureSubsetStrategy=str(params.get("colsample_bytree", "all")),
        maxBins=64)


def pipeline(features: list[str], params: dict) -> Pipeline:
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")
    return Pipeline(stages=[asm, _gbt(params)])


#: training rows from which ``boost`` grows the trees; below, a pass costs MLlib less than starting its tasks costs ``boost``
BOOST_ROWS = 1_000_000


def fit(rows: DataFrame, features: list[str], params: dict) -> PipelineModel:
    """The pipeline fitted to the rows."""
    asm, booster = pipeline(features, params).getStages()
    n = rows.count()
    if n < BOOST_ROWS or not BO.can_fit(booster):
        return pipeline(features, params).fit(rows)
    return PipelineModel([asm, BO.fit(rows, features, P.TARGET, booster, n)])


@dataclass
class TrainResult:
    model: PipelineModel
    features: list[str]
    params: dict
    metrics: dict = field(default_factory=dict)


def train(df: DataFrame, features: list[str] = P.FEATURES_V3, params: dict | None = None,
          test_pct: int = 20) -> TrainResult:
    """Fit on the train split; one metrics aggregate for both splits."""
    params = dict(P.BOOSTER_DEFAULTS if params is None else params)
    d = stage(split(df, test_pct).select("id", P.TARGET, "is_test", *features), "train_rows")
    model = fit(d.where(~F.col("is_test")), features, params)
    rows = {r["is_test"]: r.asDict() for r in MT.all_metrics(model.transform(d), "is_test", P.TARGET, "prediction").collect()}
    names = ("rmse", "mae", "r2", "ppe10", "ppe20", "mdape")
    m = {f"{part}_{k}": rows.get(flag, {}).get(k) for part, flag in (("train", False), ("test", True)) for k in names}
    return TrainResult(model, list(features), params, m)


def metrics_frame(spark: SparkSession, res: TrainResult) -> DataFrame:
    return spark.createDataFrame([tuple(res.metrics.values())],
                                 ", ".join(f"{k} double" for k in res.metrics))


def predict(model: PipelineModel, df: DataFrame, out_col: str = "model_price") -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", out_col).drop("features")


def feature_importance(spark: SparkSession, res: TrainResult) -> DataFrame:
    imp = res.model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(res.features, imp), key=lambda x: -x[1])
    return spark.createDataFrame(rows, "feature string, importance double")


# ------------------------------------------------------------------ persistence / run log

def save(res: TrainResult, path: str) -> None:
    """Model via MLlib writer + one JSON metadata file (features, params, metrics)."""
    res.model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    meta = json.dumps({"features": res.features, "params": res.params, "metrics": res.metrics,
                       "saved_at": time.time()})
    spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(path: str) -> TrainResult:
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return TrainResult(PipelineModel.load(f"{path}/model"), meta["features"], meta["params"], meta["metrics"])


def log_run(spark: SparkSession, res: TrainResult, path: str, run_name: str = "train") -> DataFrame:
    """Append one row (params + metrics as JSON) to a runs table."""
    row = spark.createDataFrame(
        [(run_name, time.time(), json.dumps(res.params), json.dumps(res.metrics), len(res.features))],
        "run_name string, ts double, params string, metrics string, n_features int")
    row.write.mode("append").parquet(path)
    return spark.read.parquet(path)


# ------------------------------------------------------------------ tuning

def sample_params(n: int, seed: int = 42) -> list[dict]:
    """Seeded random sample of the 6-dim search space."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lo, hi, _ = P.TUNING_SPACE["learning_rate"]
        out.append({
            "learning_rate": math.exp(rng.uniform(math.log(lo), math.log(hi))),
            "max_depth": rng.randint(*P.TUNING_SPACE["max_depth"][:2]),
            "subsample": rng.uniform(*P.TUNING_SPACE["subsample"][:2]),
            "n_estimators": rng.randint(*P.TUNING_SPACE["n_estimators"][:2]),
            "min_child_weight": rng.randint(*P.TUNING_SPACE["min_child_weight"][:2]),
            "colsample_bytree": rng.uniform(*P.TUNING_SPACE["colsample_bytree"][:2]),
        })
    return out


#: rows a partition of the staged folds: a fit's jobs are as wide as the data needs, not as the cluster is
FOLD_PARTITION_ROWS = 100_000


def tune(df: DataFrame, features: list[str] = P.FEATURES_V3, trials: int = P.TUNING_TRIALS,
         folds: int = 5, parallelism: int = P.TUNING_PARALLELISM, seed: int = 42,
         id_col: str = "id") -> tuple[dict, DataFrame]:
    """Seeded random search with k-fold CV RMSE.  All ``trials`` x ``folds`` fits
    are made, ``parallelism`` of them at a time, each in a scheduler pool of
    its own (which counts where spark.scheduler.mode is FAIR); what comes out
    doesn't depend on the machine's speed.  Folds come from the id's hash; the
    assembled rows are staged once.  Returns the best parameters (the first of
    equals) and a table of (trial, params, cv_rmse)."""
    rows = split(df).where(~F.col("is_test")).select(
        F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(folds)).alias("fold"), P.TARGET, *features)
    rows = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(rows)
    rows = stage(rows.select("fold", P.TARGET, "features"), "tune_rows")
    rows = rows.coalesce(max(1, -(-rows.count() // FOLD_PARTITION_ROWS)))
    sampled = sample_params(trials, seed)
    context = df.sparkSession.sparkContext

    def fit(job: tuple[int, int]) -> float:
        trial, k = job
        context.setLocalProperty("spark.scheduler.pool", f"tune-{trial}-{k}")
        share = f"{min(1.0, max(0.0, sampled[trial]['colsample_bytree'])):.3f}"
        model = _gbt({**sampled[trial], "colsample_bytree": share, "seed": seed}).fit(rows.where(F.col("fold") != k))
        ev = RegressionEvaluator(labelCol=P.TARGET, predictionCol="prediction", metricName="rmse")
        return ev.evaluate(model.transform(rows.where(F.col("fold") == k)))

    jobs = [(i, k) for i in range(trials) for k in range(folds)]
    # the longest first, so that no long fit is left over at the end
    order = sorted(jobs, key=lambda j: -sampled[j[0]]["n_estimators"] * 2 ** sampled[j[0]]["max_depth"])
    with ThreadPool(parallelism) as pool:
        scores = dict(zip(order, pool.map(inheritable_thread_target(df.sparkSession)(fit), order, chunksize=1)))
    done = [(i, json.dumps(sampled[i]), sum(scores[i, k] for k in range(folds)) / folds) for i in range(trials)]
    table = df.sparkSession.createDataFrame(done, "trial int, params string, cv_rmse double")
    return sampled[min(done, key=lambda r: (r[2], r[0]))[0]], table


# ------------------------------------------------------------------ scenarios / invariance

def scenario_grid(df: DataFrame, model: PipelineModel, features: list[str],
                  scenarios: list[tuple[str, float, int] | tuple[str, float, int, int]],
                  feature_year: int = P.FEATURE_YEAR) -> DataFrame:
    """Per listing x scenario (name, sqft multiplier, condition delta and, if
    given, bedrooms delta, which leaves the condition as it is):
    recompute derived features, re-predict, delta and pct (0 if base <= 0).
    The scenario list is a literal array (exploded), not a joined table."""
    arr = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(m)).alias("_mult"), F.lit(int(c)).alias("_dcond"),
                             F.lit(int(sum(beds))).alias("_dbeds")) for n, m, c, *beds in scenarios])
    base = predict(model, df, "base_price")
    x = base.withColumn("_s", F.explode(arr)).select("*", "_s.*").drop("_s")
    moved = F.least(F.greatest(F.col("condition") + F.col("_dcond"), F.lit(1)), F.lit(5))
    x = x.withColumns({
        "sqft": F.col("sqft") * F.col("_mult"),
        "condition": F.when(F.col("_dbeds") != 0, F.col("condition")).otherwise(moved),
        "bedrooms": F.col("bedrooms") + F.col("_dbeds"),
    })
    x = FE.derived_features(x, feature_year)
    out = predict(model, x.drop("features"), "scenario_price")
    delta = F.col("scenario_price") - F.col("base_price")
    return out.withColumns({
        "delta": delta,
        "delta_pct": F.when(F.col("base_price") > 0, delta / F.col("base_price") * 100).otherwise(F.lit(0.0)),
    })


INVARIANCE_SCENARIOS = [("sqft_up", 4.0 / 3.0, 0), ("condition_up", 1.0, 2), ("bedrooms_up", 1.0, 0, 1)]


def invariance_tests(df: DataFrame, model: PipelineModel, features: list[str]) -> DataFrame:
    """Violation rate per rule over *all* rows: more sqft / better condition /
    one more bedroom must not lower the predicted price.  The base price is
    predicted once for all rules."""
    allg = scenario_grid(df, model, features, INVARIANCE_SCENARIOS).select("scenario", "delta")
    return allg.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("delta") < 0).alias("violations"),
        (F.count_if(F.col("delta") < 0) * 100.0 / F.count(F.lit(1))).alias("violation_pct"),
        (F.count_if(F.col("delta") < 0) == 0).alias("passed"))
