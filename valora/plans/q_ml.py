"""Machine-learning queries.

Registered queries train the original booster configuration (100 trees,
depth 6, rate 0.1, seed 42: ``params.BOOSTER_DEFAULTS``).  A trained model is
kept for the session that trained it and the files it was trained on.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from valora import params as P
from valora.operators import iforest as IF
from valora.operators import memo as ME
from valora.operators import ml as ML
from valora.operators import quality as QU
from valora.operators import treeshap as TS
from valora.operators import valuation as VA
from valora.plans.catalog import register, with_views
from valora.session import ensure_checkpoint_dir, stage
from valora.sources.tables import listings

REG_PARAMS = dict(P.BOOSTER_DEFAULTS)
_CACHE: dict = {}


def _features(spark, sf):
    return ML.feature_table(listings(spark, sf))


def _version(spark, sf) -> tuple:
    """The session's application and the state of the listing files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/orders.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    return spark.sparkContext.applicationId, sf, status.getModificationTime(), status.getLen()


def _scratch(spark, kind):
    return os.path.join(ensure_checkpoint_dir(spark), "models", f"{kind}-{uuid.uuid4().hex[:12]}")


def _model(spark, sf):
    key = ("model", sf, *_version(spark, sf))
    if key not in _CACHE:
        feats = stage(_features(spark, sf), "model_features")
        _CACHE[key] = (ML.train(feats, P.FEATURES_V3, REG_PARAMS), feats)
    return _CACHE[key]


def _trees(spark, sf):
    key = ("trees", *_version(spark, sf))
    if key not in _CACHE:
        res, _ = _model(spark, sf)
        _CACHE[key] = TS.load_trees(spark, res.model, _scratch(spark, "gbt"))
    return _CACHE[key]


def _explained(spark, sf):
    res, feats = _model(spark, sf)
    trees, w = _trees(spark, sf)
    return TS.explain(feats, trees, w, res.features)


# ------------------------------------------------------------------ M1, P4, A16

@register("outlier_isolation_forest")
def q_iforest(spark, sf):
    out = IF.isolation_forest(QU.impute_sqft(listings(spark, sf)))
    return out.select("id", "anomaly_score", "is_outlier")


@register("outlier_review")
def q_outlier_review(spark, sf):
    """Flagged rows with their reasons (the review file content)."""
    from valora.operators.features import price_per_sqft
    base = price_per_sqft(QU.impute_sqft(listings(spark, sf)))
    flagged = IF.isolation_forest(base).where("is_outlier")
    return QU.outlier_reasons(base, flagged).select(
        "id", "price", "sqft", "price_per_sqft", "bedrooms", "year_built", "condition", "zip_code", "reason")


# ------------------------------------------------------------------ M2-M4, M7, M12

@register("train_test_split", with_views("listings") + """
SELECT id, ((id * 7919 + 42) % 100) < 20 AS is_test FROM listings""")
def q_split(spark, sf):
    return ML.split(listings(spark, sf)).select("id", "is_test")


@register("train_price_model")
def q_train(spark, sf):
    """Fit (once per process and tables; later model queries reuse it) and
    report train/test RMSE, MAE, R2, PPE10/20 and MdAPE."""
    res, _ = _model(spark, sf)
    return ML.metrics_frame(spark, res)


@register("predict_batch")
def q_predict(spark, sf):
    res, feats = _model(spark, sf)
    return ML.predict(res.model, feats).select("id", "model_price")


@register("feature_importance")
def q_importance(spark, sf):
    res, _ = _model(spark, sf)
    return ML.feature_importance(spark, res)


@register("score_and_status")
def q_score_status(spark, sf):
    res, feats = _model(spark, sf)
    out = VA.valuation_status(ML.predict(res.model, feats))
    return out.select("id", "price", "model_price", "price_delta", "price_delta_pct", "valuation_status")


# ------------------------------------------------------------------ M6, M9, M10, M11, P16

@register("save_load")
def q_save_load(spark, sf):
    res, feats = _model(spark, sf)
    path = _scratch(spark, "pipeline")
    ML.save(res, path)
    back = ML.load(path)
    return ML.predict(back.model, feats).select("id", "model_price")


@register("run_log")
def q_run_log(spark, sf):
    res, _ = _model(spark, sf)
    return ML.log_run(spark, res, _scratch(spark, "runs"))


@register("invariance_tests")
def q_invariance(spark, sf):
    res, feats = _model(spark, sf)
    return ML.invariance_tests(feats, res.model, res.features)


@register("scenario_grid")
def q_scenarios(spark, sf):
    res, feats = _model(spark, sf)
    sc = [("renovate", 1.0, 1), ("extend_10pct", 1.1, 0), ("extend_and_renovate", 1.1, 1)]
    out = ML.scenario_grid(feats, res.model, res.features, sc)
    return out.select("id", "scenario", "base_price", "scenario_price", "delta", "delta_pct")


# ------------------------------------------------------------------ M5, M8, K4, W3, W6

@register("explain_batch")
def q_explain(spark, sf):
    return _explained(spark, sf)


@register("global_shap")
def q_global_shap(spark, sf):
    return TS.global_shap(_explained(spark, sf))


# ------------------------------------------------------------------ T19, T20, E5

@register("importance_sorted")
def q_importance_sorted(spark, sf):
    """K3: features by importance, descending, with their rank (<= #features rows)."""
    res, _ = _model(spark, sf)
    imp = ML.feature_importance(spark, res)
    return imp.select("feature", "importance",
                      F.row_number().over(Window.orderBy(F.desc("importance"), "feature")).alias("rank"))


@register("memo_pipeline")
def q_memo_pipeline(spark, sf):
    """E5: explanations -> retrieved market context per zip (the static
    record where nothing is retrieved) -> memo fields + analyst prompt."""
    from valora.operators import retrieval as RE
    from valora.sources.tables import table
    res, feats = _model(spark, sf)
    expl = _explained(spark, sf).select("id", "base_value", "prediction", "shap_values")
    store = RE.build_chunk_store(table(spark, sf, "documents"))
    ctx = RE.market_context_rag(listings(spark, sf), store)  # one row per listing zip
    base = feats.select("id", "zip_code", "sqft", "bedrooms", "year_built", "condition")
    j = (base.join(ctx, "zip_code", "left").join(expl, "id")
         .withColumn("shap_sorted", TS.sorted_contributions())
         .withColumnRenamed("prediction", "model_price"))
    out = ME.llm_prompt_rows(ME.memo_fields(j))
    return out.select("id", "model_price", "base_value", "price_diff_pct", "recommendation",
                      "positive_drivers", "negative_drivers", "news_highlights", "risk_factors",
                      "source_note", "llm_prompt")
