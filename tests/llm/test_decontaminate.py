import random

import pyarrow as pa
import pytest

from tests.llm.data import documents, prose
from valora.llm import decontaminate as D

ITEMS = [(i, prose(100 + i, 16 + 3 * i)) for i in range(15)] + [(50, None), (51, ""), (52, "two words"), (53, prose(100, 16))]


def edited(text, share, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(int(share * len(w))):
        p = r.randrange(len(w))
        [lambda: w.__setitem__(p, "zz"), lambda: w.insert(p, "yy"), lambda: w.pop(p)][r.randrange(3)]()
    return " ".join(w)


def test_exact_copies_are_all_found_and_nothing_else(spark):
    texts = [None, "", prose(1, 500), prose(2, 50) + " " + ITEMS[3][1].translate({c: c - 32 for c in range(97, 123)}) + "! " + prose(3, 60), ITEMS[9][1],
             prose(4, 30_000) + " " + ITEMS[14][1], prose(5, 5) + " " + ITEMS[0][1], "two, words"]
    texts.append(texts[3])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, texts, clash="edits")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in D.find_leaks(docs, items).collect()}
    assert got == {(3, 3, 0), (8, 3, 0), (4, 9, 0), (5, 14, 0), (6, 0, 0), (6, 53, 0), (7, 52, 0)}
    kept = D.drop_leaking(docs, items)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {0, 1, 2}
    assert D.find_leaks(docs.limit(0), items).count() == 0
    assert D.drop_leaking(docs, items.limit(0)).count() == len(texts)


def test_blocks_of_items_give_the_same_leaks(spark, monkeypatch):
    docs = documents(spark, [prose(7, 40) + " " + t for _, t in ITEMS[:6]])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    one = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, items).collect()}
    monkeypatch.setattr(D, "BLOCK_BYTES", 1000)
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, items).collect()} == one


def test_recall_with_edits():
    items = [(i, prose(200 + i, 20 + i % 40)) for i in range(120)]
    index = D.build(items)
    for share, least in ((0.1, 0.95), (0.19, 0.9)):
        texts = [prose(i, 37 + i) + " " + edited(t, share, i) + " " + prose(i + 1, 30) for i, t in items]
        found = D.scan(pa.array(texts), index)
        assert sum((i, i) in found for i, _ in items) >= least * len(items)
        assert all(a == b for a, b in found)


def test_edit_distance():
    import numpy as np
    a = lambda *x: np.array(x, np.uint64)
    assert D.edit_distance(a(1, 2, 3), a(9, 1, 2, 3, 9)) == 0
    assert D.edit_distance(a(1, 2, 3), a(9, 1, 3, 9)) == 1
    assert D.edit_distance(a(1, 2, 3), a()) == 3


@pytest.mark.parametrize("n", [*range(5, 61), 100])
def test_every_leak_of_every_length_is_found(n):
    r = random.Random(n)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(8))
    items = [(i, " ".join(word() for _ in range(n))) for i in range(60)]
    texts = []
    for i, (_, t) in enumerate(items):
        w = t.split()
        for p in r.sample(range(n), int(0.2 * n)):  # each word at most once, the first and last too
            w[p] = [word(), f"{word()} {w[p]}", ""][i % 3 if i < 30 else r.randrange(3)]
        around = [word() for _ in range(i % 4 * 10)]
        texts.append(" ".join([*around, *w, *around]))
    texts.append(" ".join([word(), *items[0][1].split()[1:]]))
    found = D.scan(pa.array(texts), D.build(items))
    assert set(found) == {(i, i) for i in range(60)} | {(60, 0)}


def plain_distance(item, text):
    """Least edit distance of the words to any stretch of the text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        nxt = [i]
        for j, v in enumerate(text, 1):
            nxt.append(min(row[j] + 1, nxt[j - 1] + 1, row[j - 1] + (v != w)))
        row = nxt
    return min(row)


def test_leaks_against_a_scan_of_every_stretch():
    r = random.Random(8)
    items = [(i, prose(300 + i, n)) for i, n in enumerate([5, 6, 8, 9, 12, 14, 17, 20, 24, 25, 31, 40])]
    texts = []
    for i in range(60):
        _, t = items[r.randrange(len(items))]
        texts.append(" ".join([prose(i, r.randrange(1, 40)), edited(t, r.choice([0, 0.1, 0.2, 0.3]), i), prose(900 + i, r.randrange(1, 40))]))
    found = D.scan(pa.array(texts), D.build(items))
    real = {}
    for row, t in enumerate(texts):
        for _, (ident, item) in enumerate(items):
            d = plain_distance(item.split(), t.split())
            if d <= int(D.EDIT_SHARE * len(item.split())):
                real[row, ident] = d
    assert set(found) <= set(real) and len(real) > 25
    assert len(found) >= D.TARGET_RECALL * len(real)
    assert all(found[k][0] >= real[k] for k in found)
    assert sum(found[k][0] == real[k] for k in found) >= D.TARGET_RECALL * len(found)


@pytest.mark.parametrize("n", [5, 10, 14, 23, 24, 40])
def test_recall_where_no_stretch_is_far_from_an_edit(n):
    """Edits at even gaps leave the shortest untouched stretches."""
    r = random.Random(n)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(8))
    items = [(i, " ".join(word() for _ in range(n))) for i in range(100)]
    texts, k = [], int(0.2 * n)
    for i, (_, t) in enumerate(items):
        w = t.split()
        for j in range(k):
            w[int((j + 0.5) * n / k)] = [word(), f"{word()} {word()}", ""][i % 3]
        texts.append(" ".join([*(word() for _ in range(i % 23)), *w, word()]))
    found = D.scan(pa.array(texts), D.build(items))
    most = {i for i in range(100) if plain_distance(items[i][1].split(), texts[i].split()) <= k}
    assert len({i for i in most if (i, i) in found}) >= D.TARGET_RECALL * len(most)


def test_walks_fall_into_step_again():
    import numpy as np
    how = D.Plan(1, 60, 60, 1, 1)
    x = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    y = np.delete(x, 20)

    def given(words):
        bits, at, out = D.mix64(np.concatenate([words, np.zeros(61, np.uint64)]) + D.MULT), 0, []
        for t in range(60):
            out.append(words[at])
            at += int(bits[at] >> np.uint64(t)) & 1
        return out

    differ = [a != b for a, b in zip(given(x), given(y))]
    assert sum(differ) < 40 and not any(differ[:15])
    sig, _, _ = next(D._walks(x, np.array([0]), how))
    same, _, _ = next(D._walks(x.copy(), np.array([0]), how))
    assert sig[0] == same[0]


def test_string_ids_repeated_items_and_a_repeated_word(spark):
    items = [("x", prose(1, 20)), ("y", prose(1, 20)), (None, prose(1, 20)), ("z", "spam " * 30), ("z", "spam " * 30)]
    docs = spark.createDataFrame([("a", prose(1, 20), 1), ("b", "spam " * 5000, 2), ("c", "spam " * 20, 3), ("a", prose(1, 20), 1)],
                                 "doc_id string, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = sorted((r["doc_id"], str(r["item_id"]), r["edits"]) for r in D.find_leaks(docs, bench).collect())
    assert got == sorted([("a", "x", 0), ("a", "y", 0), ("a", "None", 0)] * 2 + [("b", "z", 0)] * 2)
    assert [r["doc_id"] for r in D.drop_leaking(docs, bench).collect()] == ["c"]
