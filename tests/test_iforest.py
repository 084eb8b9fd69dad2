import numpy as np
import pandas as pd

from valora.operators import iforest as IF


def rows(n, seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(n), "price": rng.normal(1e6, 1e5, n), "sqft": rng.normal(1500, 200, n),
                        "bedrooms": rng.integers(1, 5, n).astype(float)})
    pdf.loc[::17, "sqft"] = None
    pdf.loc[:4, "price"] = 9e6
    return pdf


def test_fit_save_load_and_score_a_new_table(spark, tmp_path):
    old, new = (spark.createDataFrame(rows(n, s)) for n, s in ((800, 1), (90, 2)))
    est = IF.IsolationForest(nTrees=20, maxSamples=64, contamination=0.02)
    model = est.fit(old)
    both = IF.isolation_forest(old, n_trees=20, max_samples=64, contamination=0.02)
    as_rows = lambda df: [tuple(r) for r in df.select("id", "anomaly_score", "is_outlier").orderBy("id").collect()]
    assert as_rows(model.transform(old)) == as_rows(both)
    assert sum(r[2] for r in as_rows(both)) == 16
    model.save(str(tmp_path / "forest"))
    again = IF.IsolationForestModel.load(str(tmp_path / "forest"))
    assert as_rows(again.transform(new)) == as_rows(model.transform(new))
    assert again.threshold == model.threshold and again.getOrDefault("nTrees") == 20 and again.uid == model.uid
    est.save(str(tmp_path / "estimator"))
    assert IF.IsolationForest.load(str(tmp_path / "estimator")).getOrDefault("maxSamples") == 64


def test_scores_equal_a_walk_of_each_tree(spark):
    pdf = rows(300, 3)
    model = IF.IsolationForest(nTrees=7, maxSamples=32).fit(spark.createDataFrame(pdf))
    got = {r["id"]: r["anomaly_score"] for r in model.transform(spark.createDataFrame(pdf)).collect()}
    feats = list(model.medians)
    pdf["price_per_sqft"] = pdf.price / pdf.sqft
    x = pdf[feats].fillna(model.medians)

    def depth(tree, v):
        node, steps = 0, 0
        while tree.feature[node] >= 0:
            node = tree.left[node] if v[tree.feature[node]] < tree.threshold[node] else tree.right[node]
            steps += 1
        return steps + IF.c_factor(tree["size"][node])

    trees = [g.sort_values("node").reset_index(drop=True) for _, g in model.nodes.groupby("tree")]
    assert len(trees) == 7
    for i in range(0, 300, 13):
        mean = sum(depth(t, x.iloc[i].to_numpy()) for t in trees) / 7
        assert abs(got[i] - 2 ** (-mean / IF.c_factor(model.psi))) < 1e-12


def test_fewer_than_two_features_flag_nothing(spark):
    out = IF.IsolationForest(features=["price", "nope"]).fit(spark.createDataFrame(rows(20, 4))).transform(spark.createDataFrame(rows(20, 4)))
    assert out.where("is_outlier or anomaly_score is not null").count() == 0
