"""Quality classifier: ordinal regression with a cumulative logit link.

Grades are ordered: 0 toxic, 1 poor, 2 good.  One weight vector over hashed
words is shared by all grades, ordered thresholds cut its score:
P(grade <= g) = sigmoid(t_g - w x).  That gives the expected grade and the tail
probabilities P(grade >= g); documents whose tail at ``SELECT`` is at least
one half are selected.

Features: the different words of the whole text by hash, and the text's share
of signs, capitals and different words, in steps, as words of their own.  Only
their presence counts, so one telling word weighs the same in a long text.

Fitted by proximal steps (Adam with an L1 shrinkage) on a bounded sample: the
``FIT_ROWS`` labelled documents with the smallest hash of their id.  Scoring
reads whole texts; the weights (``BUCKETS`` numbers) are broadcast.

Defined cases: labels without a grade (null) are not used; a document with two
labels counts twice in the fit; a null or empty text has grade 0, probability
0 and isn't selected; without labels nothing is known and all get the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructType

from valora.llm.common import fresh, read, register, smallest_hashes
from valora.llm.textops import mix64, row_groups, text_buffer, word_hashes

GRADES, SELECT = 3, 2
BUCKETS = 1 << 17
FIT_ROWS, ROUNDS, RATE, SHRINK = 12_000, 250, 0.05, 2e-4
STEPS = 12

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[65:91] = _PLAIN[97:123] = True
_PLAIN[128:] = True
_PLAIN[[32, 10, 44, 46]] = True


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the rows' different features, and the rows' offsets."""
    words, ptr = word_hashes(buf, off)
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(ptr))
    pair = np.unique(row.astype(np.int64) * BUCKETS + (words % np.uint64(BUCKETS)).astype(np.int64))
    size = np.maximum(np.diff(off), 1)

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[off[1:]] - total[off[:-1]]) / size

    kinds = np.bincount(pair // BUCKETS, minlength=n) / np.maximum(np.diff(ptr), 1)
    more = []
    for k, value in enumerate((share(~_PLAIN[buf]), share(_UPPER[buf]), kinds)):
        step = np.minimum((np.sqrt(value) * STEPS).astype(np.int64), STEPS)
        token = mix64((step + 1 + 100 * (k + 1)).astype(np.uint64))
        some = np.flatnonzero(np.diff(ptr) > 0)
        more.append(some * BUCKETS + (token[some] % np.uint64(BUCKETS)).astype(np.int64))
    pair = np.unique(np.concatenate([pair, *more]))
    return (pair % BUCKETS).astype(np.int32), np.searchsorted(pair // BUCKETS, np.arange(n + 1))


def sums(weights: np.ndarray, idx: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    out, some = np.zeros(len(ptr) - 1), ptr[1:] > ptr[:-1]
    if some.any():
        out[some] = np.add.reduceat(weights[idx], ptr[:-1][some])
    return out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(idx: np.ndarray, ptr: np.ndarray, grade: np.ndarray, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thresholds) of largest penalised likelihood."""
    w = np.zeros(BUCKETS)
    # thresholds as the first one and logarithms of the steps between them
    cum = np.clip([np.mean(grade <= g) if len(grade) else 0.5 for g in range(grades - 1)], 0.01, 0.99)
    logit = np.maximum.accumulate(np.log(cum / (1 - cum)) + 1e-3 * np.arange(grades - 1))
    raw = np.concatenate([logit[:1], np.log(np.maximum(np.diff(logit), 1e-3))])
    thresholds = lambda: np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])
    if not len(grade):
        return w, thresholds()
    m, v = np.zeros(BUCKETS + len(raw)), np.zeros(BUCKETS + len(raw))
    for step in range(1, ROUNDS + 1):
        t, score = thresholds(), sums(w, idx, ptr)
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        hi, lo = _sigmoid(edge[grade + 1] - score), _sigmoid(edge[grade] - score)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        d_score = (dhi - dlo) / len(grade)  # of the negative log likelihood
        g_w = np.bincount(idx, np.repeat(d_score, np.diff(ptr)), BUCKETS)
        g_t = np.array([(dlo[grade == k + 1].sum() - dhi[grade == k].sum()) / len(grade) for k in range(len(t))])
        g_raw = np.concatenate([[g_t.sum()], [g_t[k:].sum() * np.exp(raw[k]) for k in range(1, len(t))]])
        g = np.concatenate([g_w, g_raw])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, raw = w - move[:BUCKETS], raw - move[BUCKETS:]
        size = RATE / (np.sqrt(v[:BUCKETS] / (1 - 0.999**step)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - SHRINK * size, 0)
    return w, thresholds()


def tails(score: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(rows, grades - 1): P(grade >= 1), P(grade >= 2), ..."""
    return 1 - _sigmoid(t[None, :] - score[:, None])


def fit_sample(docs: DataFrame, labels: DataFrame, grade, ident: str = "doc_id", text: str = "text"):
    """Fit on the labelled documents with the smallest hash of their id."""
    marks = labels.select(F.col(ident).alias("k"), grade.cast("int").alias("g")).where("g is not null and k is not null")
    chosen = smallest_hashes(marks, ["k", "g"], FIT_ROWS, marks.count())
    rows = docs.select(F.col(ident).alias("k"), F.col(text).alias("t")).join(chosen, "k").select("k", "t", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = text_buffer(b.column(1))
            for i, j in row_groups(off):
                idx, ptr = features(buf[off[i]: off[j]], off[i: j + 1] - off[i])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i),
                     pa.array([idx[a:z].tobytes() for a, z in zip(ptr[:-1], ptr[1:])], pa.binary())], names=["k", "g", "x"])

    got = rows.mapInArrow(run, "k long, g int, x binary").toArrow().sort_by([("k", "ascending"), ("g", "ascending")])
    x = [np.frombuffer(b, np.int32) for b in got.column("x").to_pylist()]
    ptr = np.concatenate([[0], np.cumsum([len(a) for a in x])]).astype(np.int64)
    idx = np.concatenate(x) if x else np.empty(0, np.int32)
    return fit(idx, ptr, got.column("g").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade``, ``p_1``, ``p_2``, ... (tails) and
    ``keep``."""
    names = fresh(docs, "expected_grade", *(f"p_{g}" for g in range(1, len(model[1]) + 1)), "keep")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = shared.value
        for b in batches:
            buf, off = text_buffer(b.column(at))
            parts = []
            for i, j in row_groups(off):
                idx, ptr = features(buf[off[i]: off[j]], off[i: j + 1] - off[i])
                p = tails(sums(w, idx, ptr), t)
                p[np.diff(ptr) == 0] = 0.0
                parts.append(p)
            p = np.concatenate(parts) if parts else np.empty((0, len(t)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(p.sum(axis=1)), *(pa.array(p[:, g]) for g in range(len(t))),
                 pa.array(p[:, SELECT - 1] >= 0.5)], names=[*b.schema.names, *names])

    schema = StructType([*docs.schema.fields])
    for n in names[:-1]:
        schema = schema.add(n, DoubleType())
    return docs.mapInArrow(run, schema.add(names[-1], BooleanType()))


def document_grade():
    """0 toxic, 1 poor, 2 good."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality").isNotNull(), 1 + F.col("quality"))


@register("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_sample(docs, read(spark, sf_dir, "labels"), document_grade())
    return score(docs, model).drop("text")
