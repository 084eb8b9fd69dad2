from pyspark.sql import functions as F

from valora import params as P
from valora.operators import ml as ML

SMALL = [{"learning_rate": r, "max_depth": d, "subsample": 1.0, "n_estimators": 2 + i, "min_child_weight": 1, "colsample_bytree": 1.0}
         for i, (r, d) in enumerate([(0.1, 2), (0.3, 1), (0.3, 2)])]


def test_all_fits_are_made_and_concurrency_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(ML, "sample_params", lambda n, seed: SMALL[:n])
    rows = spark.range(200).select("id", (F.col("id") * 1000.0).alias(P.TARGET), (F.col("id") * 1.0).alias("a"))
    one, serial = ML.tune(rows, ["a"], trials=3, folds=2, parallelism=1)
    two, pooled = ML.tune(rows.repartition(5), ["a"], trials=3, folds=2, parallelism=6)
    assert [tuple(r) for r in serial.orderBy("trial").collect()] == [tuple(r) for r in pooled.orderBy("trial").collect()]
    assert one == two == SMALL[min(range(3), key=lambda i: serial.collect()[i]["cv_rmse"])]


def test_cv_rmse_is_the_mean_over_folds(spark, monkeypatch):
    monkeypatch.setattr(ML, "sample_params", lambda n, seed: SMALL[:1])
    rows = spark.range(120).select("id", (F.col("id") * 10.0).alias(P.TARGET), (F.col("id") * 1.0).alias("a"))
    _, table = ML.tune(rows, ["a"], trials=1, folds=3)
    train = ML.split(rows).where("not is_test").withColumn("fold", F.expr("pmod(xxhash64(id, 42), 3)"))
    errors = []
    for k in range(3):
        model = ML.pipeline(["a"], {**SMALL[0], "colsample_bytree": "1.000", "seed": 42}).fit(train.where(f"fold <> {k}").coalesce(1))
        out = model.transform(train.where(f"fold = {k}")).select(F.sqrt(F.avg((F.col(P.TARGET) - F.col("prediction")) ** 2))).first()
        errors.append(out[0])
    assert abs(table.first()["cv_rmse"] - sum(errors) / 3) < 1e-6 * max(errors)
