import random
import re

import numpy as np
import xxhash

from tests.llm.data import documents, prose
from valora.llm import simhash as S


def plain(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not w:
        return 0
    sh = [b" ".join(w[i: i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, ids):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    low = {}
    for r, i in zip(root, ids):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [low.get(r) for r in root]


def near_texts():
    base, out = prose(1, 400).split(), []
    for i in range(60):
        w = list(base)
        for k in range(i % 4):
            w[(i * 37 + k * 11) % 400] = "zz"
        out.append(" ".join(w))
    return out


def test_fingerprints(monkeypatch):
    texts = [None, "", " \t", "One", "one two", "a\x0bB c", "x " * 9, prose(3, 500), "ÉÀ b c d", *near_texts()[:3]]
    want = [plain(t) for t in texts]
    assert [S.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(S, "PIECE", 7)
    assert [S.fingerprint(t) for t in texts] == want


def test_groups_equal_brute_force(spark):
    texts = [None, "", prose(9, 80), *near_texts(), *[prose(5, 50)] * 40]
    docs = documents(spark, texts, clash="fp")
    marked = S.fingerprints(docs, out="_fp")
    rows = marked.join(S.groups(marked.select("doc_id", "_fp"), "doc_id", "_fp").withColumnRenamed("fp", "_fp"), "_fp").collect()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    want = brute([plain(t) for t in texts], list(range(len(texts))))
    assert [got[i] for i in range(len(texts))] == want
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert S.keep_one(docs.limit(0)).count() == 0


def test_one_of_repeated_rows_and_null_ids_stays(spark):
    one = prose(4, 90)
    docs = spark.createDataFrame([(None, one), (3, one), (3, one), (None, "x y z"), (None, "x y z")], "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in S.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(3, one), (None, "x y z")], key=str)


def test_links_connect_what_all_pairs_connect(spark, monkeypatch):
    """Dense balls, so that keys are refined."""
    monkeypatch.setattr(S, "GROUP", 8)
    monkeypatch.setattr(S, "FREE_BITS", 20)
    r, fps = random.Random(2), set()
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(120):
            y = x
            for _ in range(r.randrange(6)):
                y ^= 1 << r.randrange(64)
            fps.add(y)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    from valora.llm.common import components
    found = {r["node"]: r["root"] for r in components(S.links(nodes)).collect()}
    a = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 3) + i + 1:
            x, y = top(i), top(int(j))
            root[max(x, y)] = min(x, y)
    label = [found.get(S._signed(x), S._signed(x)) for x in fps]
    pairs = {(top(i), label[i]) for i in range(len(fps))}
    assert len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs})
