import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.data import documents, prose
from valora.llm import suffix_dedup as S


def brute(texts):
    data, seen = [(t or "").encode() for t in texts], Counter()
    for x in data:
        seen.update(x[i: i + 400] for i in range(len(x) - 399))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - 399):
            if seen[x[i: i + 400]] > 1:
                gone[i: i + 400] = b"\1" * 400
        out.append(bytes(gone))
    return out


def texts():
    r = random.Random(4)
    shared, base = prose(1, 150), prose(2, 300)
    out = [None, "", "abc", "a" * 1500, "ab" * 600, "x" * 399, "y" * 400, "Los " * 300, prose(3, 200) + shared + prose(4, 20)]
    out += [prose(10 + i, 5 + 4 * i) + " " + [shared, shared[:500], shared[90:]][i % 3] + " " + prose(90 + i, 3 * i) for i in range(30)]
    for _ in range(15):
        w = base.split()
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(len(w))] = "zz"
        out.append(" ".join(w))
    return out + [base] * 4 + [base + " " + base[200:900], prose(7, 20_000)]


@pytest.mark.parametrize("sort_rows", [8000, 25])
def test_equals_brute_force(spark, monkeypatch, sort_rows):
    monkeypatch.setattr(S, "SORT_ROWS", sort_rows)  # small: runs cross the boundaries
    docs = documents(spark, texts(), clash="kept")
    out = S.dedup(docs)
    assert out.columns == [*docs.columns, "_kept", "removed"]
    got = {r["doc_id"]: r for r in out.collect()}
    for i, (t, gone) in enumerate(zip(texts(), brute(texts()))):
        data = (t or "").encode()
        assert bytes(got[i]["_kept"]) == bytes(c for c, g in zip(data, gone) if not g)
        runs = [(x["lo"], x["hi"]) for x in got[i]["removed"]]
        assert sum(hi - lo for lo, hi in runs) == sum(gone)
        assert all(a[1] < b[0] for a, b in zip(runs, runs[1:]))


def one_gram(n):
    """Pairs and more of texts that share 500 bytes; all shared passages have
    the same anchor gram, and different bytes after it."""
    r = random.Random(8)
    word = lambda k: "".join(r.choice("abcdefghijklmnop") for _ in range(k))
    grams = [word(8) for _ in range(300_000)]
    with np.errstate(over="ignore"):
        h = np.array([int.from_bytes(g.encode(), "little") for g in grams], np.uint64) * S.MULT >> np.uint64(32)
    gram, out = grams[int(h.argmin())], []
    for _ in range(n):
        shared = word(150) + gram + word(342)
        out += [word(40 + 3 * k) + shared + word(30 + k) for k in range(2 + r.randrange(3))]
    return out


def test_runs_behind_one_gram_cut_by_many_boundaries(spark, monkeypatch):
    monkeypatch.setattr(S, "SORT_ROWS", 25)
    some = one_gram(120)
    got = {r["doc_id"]: r for r in S.dedup(documents(spark, some)).collect()}
    for i, (t, gone) in enumerate(zip(some, brute(some))):
        assert bytes(got[i]["kept"]) == bytes(c for c, g in zip(t.encode(), gone) if not g)


def test_empty_table_and_no_repeats(spark):
    assert S.dedup(documents(spark, ["a"]).limit(0)).count() == 0
    assert [r["removed"] for r in S.dedup(documents(spark, [prose(1, 300), prose(2, 300)])).collect()] == [[], []]


def test_multikey_quicksort():
    r = np.random.default_rng(0)
    t = r.integers(0, 3, (500, 6)).astype(np.uint64)
    assert (t[S.multikey_order(t)] == t[np.lexsort(t.T[::-1])]).all()


def test_slices_of_a_long_text_hold_each_start_once():
    rng = np.random.default_rng(1)
    long = np.frombuffer(rng.bytes(30_000) + b"ab" * 9_000 + rng.bytes(500), np.uint8)
    short = np.frombuffer(rng.bytes(900), np.uint8)
    buf = np.concatenate([short, long, short, short])
    off = np.cumsum([0, 900, len(long), 900, 900])
    starts = {}
    for first, x in S.sliced_anchors(buf, off, limit=1500):
        for row, at, lo, hi in zip(x["row"] + first, x["at"], x["dmin"], x["dmax"]):
            for d in range(lo, hi + 1):
                starts[row, at - d] = starts.get((row, at - d), 0) + 1
                text = buf[off[row]: off[row + 1]]
                assert 0 <= d < S.SPAN and at + 8 <= len(text) + 8
    want = {(r, s) for r in range(4) for s in range(off[r + 1] - off[r] - S.LENGTH + 1)}
    assert set(starts) == want and set(starts.values()) == {1}


def test_a_very_long_text_and_a_thousand_copies_of_another(spark):
    shared = prose(5, 180)
    long = prose(6, 420_000) + shared + " " + prose(8, 3_000)  # over two slices of a megabyte
    texts = [long, prose(9, 50) + shared] + [prose(11, 200)] * 1000 + [prose(12 + i, 100) + prose(11, 200)[100:700] for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: [(x["lo"], x["hi"]) for x in r["removed"]] for r in S.dedup(docs).collect()}
    seen, data = Counter(), [t.encode() for t in texts]
    for x in data:
        seen.update(hash(x[i: i + 400]) for i in range(len(x) - 399))
    assert len(data[0]) > 2 << 20
    for n in (0, 1, 2, 1001, 1002, 1021):
        gone = bytearray(len(data[n]))
        for i in range(len(data[n]) - 399):
            if seen[hash(data[n][i: i + 400])] > 1:
                gone[i: i + 400] = b"\1" * 400
        mine = bytearray(len(data[n]))
        for lo, hi in got[n]:
            mine[lo:hi] = b"\1" * (hi - lo)
        assert mine == gone


def test_the_query_cuts_passages_by_bytes_whatever_their_words(spark, tmp_path):
    """Shared passages of over 50 words with 399 bytes stay, those with 400 go;
    n_bytes is the size of the input text either way."""
    texts, shared = [], {}
    for n, size in enumerate([330, 399, 400, 401, 470]):
        words, k = ["été", "año"] + prose(40 + n, 400).split(), 51
        while len(" ".join(words[:k + 1]).encode()) <= size:
            k += 1
        passage = " ".join(words[:k])
        passage += "q" * (size - len(passage.encode()))
        assert len(passage.split()) > 50 and len(passage.encode()) == size > len(passage)
        for at in range(2):  # digits differ on both sides of the passage
            shared[len(texts)] = size
            texts.append(f"{prose(60 + 2 * n + at, 40)} {at}{passage}{at} {prose(80 + 2 * n + at, 30)}")
    texts += [prose(99, 300), None, ""]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in S.op10_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, (t, gone) in enumerate(zip(texts, brute(texts))):
        data = (t or "").encode()
        removed = shared.get(i, 0) if shared.get(i, 0) >= 400 else 0
        kept = bytes(c for c, g in zip(data, gone) if not g)
        assert sum(gone) == removed
        assert tuple(got[i])[1:] == (len(data), removed, int(removed > 0), hashlib.sha256(kept).hexdigest())
