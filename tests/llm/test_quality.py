import random

import numpy as np

from tests.llm.data import documents, prose
from valora.llm import quality as Q


def test_toxic_and_poor_texts_are_told_apart(spark):
    r, texts, marks = random.Random(0), [], []
    for i in range(400):
        w = prose(i % 25, 60).split()
        r.shuffle(w)
        kind = r.randrange(3)
        if kind == 0:
            w.insert(r.randrange(60), r.choice(["badword", "worseword"]))
        if kind == 1:
            w = [x + "%%%" for x in w]
        texts.append(" ".join(w))
        marks.append((i, int(kind == 2), int(kind == 0)))
    texts += [None, "", texts[0], "word " * 50_000]
    docs = documents(spark, texts, clash="keep")
    labels = spark.createDataFrame([m for m in marks if m[0] % 2] + [(401, None, None)], "doc_id long, quality int, toxic int")
    model = Q.fit_sample(docs, labels, Q.document_grade())
    out = Q.score(docs, model)
    assert out.columns == [*docs.columns, "expected_grade", "p_1", "p_2", "_keep"]
    got = {x["doc_id"]: x for x in out.collect()}
    assert len(got) == len(texts)
    held = [m for m in marks if not m[0] % 2]
    assert np.mean([got[i]["_keep"] == bool(q) for i, q, _ in held]) > 0.97
    assert np.mean([(got[i]["p_1"] < 0.5) == bool(t) for i, _, t in held]) > 0.97
    assert all(x["p_1"] >= x["p_2"] and abs(x["expected_grade"] - x["p_1"] - x["p_2"]) < 1e-9 for x in got.values())
    assert got[400]["expected_grade"] == got[401]["expected_grade"] == 0 and not got[400]["_keep"]
    assert got[402]["expected_grade"] == got[0]["expected_grade"]
    assert Q.score(docs.limit(0), model).count() == 0


def test_thresholds_are_ordered_and_no_labels_work(spark):
    docs = documents(spark, ["a b"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    w, t = Q.fit_sample(docs, none, Q.document_grade())
    assert not w.any() and np.all(np.diff(t) > 0)
    assert Q.score(docs, (w, t)).count() == 1
