import itertools
import math
import random
import re

from pyspark.sql import functions as F

from tests.llm.data import prose
from valora.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_mask(rows, i):
    doc_id, text = rows[i][0], rows[i][1] or ""
    words = WORD.findall(text)
    copy = doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), copy]


def brute_audit(fails, good, toxic):
    """(order, step) -> numbers, straight from the definition."""
    out, total = {}, [0] * 5
    for order in itertools.permutations(range(5)):
        left = list(range(len(fails)))
        for step, f in enumerate(order, 1):
            gone = [d for d in left if fails[d][f]]
            left = [d for d in left if not fails[d][f]]
            total[f] += len(gone)
            out["".join("ABCDE"[i] for i in order), step] = [
                len(left), len(gone), sum(x[f] for x in fails) - len(gone), sum(x[f] and sum(x) == 1 for x in fails),
                sum(good[d] for d in gone), sum(toxic[d] for d in gone), f]
    return {k: tuple(v[:-1] + [total[v[-1]]]) for k, v in out.items()}


def made_up(n=260):
    r = random.Random(3)
    texts = [prose(i, r.randrange(1, 400)) for i in range(n // 2)]
    texts += [f"{t} {r.choice('#$ABCXYZ ')}" * r.randrange(1, 4) for t in texts[:40]]
    texts += ["A" * 30 + " é" * 500, "word " * 300, "", None, "\x0b \x1c  ", "HOT text"]
    texts += ["HOT text"] * (n - len(texts))
    rows = [(i, t, r.choice(["en", "en", "de", None, ""])) for i, t in enumerate(texts)]
    return rows + rows[:20] + [(None, "HOT text", "en"), (None, prose(9999, 3), "fr")]


def tables(spark, rows):
    docs = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "doc_id long, text string, lang string, mask int, part int, n int")
    marks = [(i, int(i % 3 == 0), int(i % 7 == 0)) for i in range(0, 250, 2)] + [(4, 1, 0), (6, 0, 0), (8, None, None)]
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), marks


def test_audit_equals_brute_force(spark):
    rows = made_up()
    docs, labels, marks = tables(spark, rows)
    masks = A.failures(docs.repartition(5), labels)
    got = A.audit(masks, F.col("part"), F.col("mask"), F.col("good"), F.col("toxic"), F.col("n")).collect()
    good = {m[0] for m in marks if m[1] == 1}
    toxic = {m[0] for m in marks if m[2] == 1}
    parts = {x[2] or "" for x in rows}
    assert len(got) == 600 * len(parts)
    for part in parts:
        mine = [i for i, x in enumerate(rows) if (x[2] or "") == part]
        want = brute_audit([brute_mask(rows, i) for i in mine], [rows[i][0] in good for i in mine], [rows[i][0] in toxic for i in mine])
        have = {(r["filter_order"], r["step"]): tuple(r)[3:] for r in got if r["part"] == part}
        assert have == want


def test_empty_table(spark):
    docs, labels, _ = tables(spark, made_up()[:1])
    masks = A.failures(docs.limit(0), labels.limit(0))
    assert A.audit(masks, F.col("part"), F.col("mask"), F.col("good"), F.col("toxic"), F.col("n")).count() == 0


def test_every_order_once_by_adjacent_swaps():
    for n in range(7):
        order = list(range(n))
        seen = {tuple(order)}
        for level in A.adjacent_swaps(n):
            order[level], order[level + 1] = order[level + 1], order[level]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n) == 1 + sum(1 for _ in A.adjacent_swaps(n))


def test_a_swap_keeps_the_root_and_stays_small():
    r = random.Random(1)
    weights = {r.randrange(64): (r.randrange(1, 9), 0, 1) for _ in range(30)}
    d = A.Diagram("ABCDEF", weights)
    root, total = d.root, d.sums[d.root]
    for level in A.adjacent_swaps(6):
        d.swap(level)
        assert d.root == root and d.sums[root] == total
        assert all(len(x) <= 2 ** i for i, x in enumerate(d.levels))
        kept = [s[1] for s in d.steps()][-1]
        assert kept == weights.get(0, (0, 0, 0))


def test_very_long_text_is_read_in_slices(monkeypatch):
    text = " ".join(f"w{i % 70000}" for i in range(300_000)).encode()
    whole = A.text_mask(text)
    monkeypatch.setattr(A, "SLICE", 1000)
    assert sum(len(x.split()) for x in A.slices(text)) == 300_000
    assert A.text_mask(text) == whole == 2
    assert list(A.slices(b"x" * 5000)) == [b"x" * 5000]
