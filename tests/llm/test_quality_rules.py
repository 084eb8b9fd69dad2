import random
import re
from collections import Counter

from tests.llm.data import prose
from valora.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    again = {i + d for i, w in enumerate(windows) if many[w] > 1 for d in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)), len(lines)


def bin_of(v):
    low = max(0, len(f"{v:b}") - Q.BITS)
    return v >> low << low


def brute_verdicts(rows):
    """(base_failed, kept) of rows (text, lang, source)."""
    out, groups, values = [], {}, []
    for text, lang, source in rows:
        (n, chars, symbols, dup, again), lines = brute_counts(text)
        failed = n < 50 or 100 * again > 50 * n
        v = dict(zip(Q.MEASURES, map(bin_of, (1000 * chars // max(n, 1), 1000 * symbols // max(n, 1),
                                              1000 * dup // max(lines, 1), 1000 * again // max(n, 1)))))
        values.append((failed, v))
        if not failed:
            for key in ((lang or "", source or ""), (lang or "",), ()):
                groups.setdefault(key, []).append(v)

    def limits(key, m):
        sorted_ = sorted(v[m] for v in groups.get(key, []))
        if len(sorted_) < Q.MIN_DOCS:
            return None
        q = lambda p: next(x for i, x in enumerate(sorted_, 1) if 100 * i >= p * len(sorted_))
        slack, low = Q.MEASURES[m]
        step = max(3 * (q(75) - q(25)), slack)
        return (min(q(10), q(25) - step) if low else -1), max(q(90), q(75) + step)

    cache = {}
    for (failed, v), (_, lang, source) in zip(values, rows):
        kept = not failed
        for m in Q.MEASURES:
            for key in ((lang or "", source or ""), (lang or "",), ()):
                if (key, m) not in cache:
                    cache[key, m] = limits(key, m)
                if cache[key, m]:
                    low, high = cache[key, m]
                    kept &= low <= v[m] <= high
                    break
        out.append((failed, kept))
    return out


def made_up():
    r = random.Random(5)
    rows = []
    for i in range(900):
        t = prose(i, r.randrange(40, 160))
        if i % 30 == 0:
            t = t.replace(" ", "## ")
        if i % 31 == 0:
            t = t.replace(" ", "longer")
        if i % 37 == 0:
            t += "\n" + "\n".join(["one line again"] * 25)
        rows.append((t, r.choice(["en"] * 8 + ["de", None]), r.choice(["a"] * 6 + ["b", None, f"s{i}"])))
    odd = [None, "", " \t\x0b", "a", "a b c a b c", "x\n\n x\nx\r\n", "  é\x1c ñ   ok", "w " * 60, "|" * 99]
    return rows + [(t, "en", "a") for t in odd] + rows[:15]


def run(spark, rows):
    docs = spark.createDataFrame([(i, *x, 7, 8) for i, x in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, words int, kept int")
    out = Q.rules(docs.repartition(3)).collect()
    assert [r["kept"] for r in out] == [8] * len(rows)
    return sorted(out, key=lambda r: r["doc_id"])


def test_counts_and_verdicts_equal_brute_force(spark, monkeypatch):
    rows = made_up()
    for groups in (Q.BROADCAST_GROUPS, 0):  # 0: joined with salted keys
        monkeypatch.setattr(Q, "BROADCAST_GROUPS", groups)
        got = run(spark, rows)
        assert [tuple(r[c] for c in Q.COUNTS) for r in got] == [brute_counts(x[0])[0] for x in rows]
        assert [(r["base_failed"], r["_kept"]) for r in got] == brute_verdicts(rows)
    assert 0 < sum(not r["base_failed"] and not r["_kept"] for r in got) < 120


def test_small_and_empty_tables_have_no_thresholds(spark):
    rows = made_up()[:150]
    assert all(r["_kept"] != r["base_failed"] for r in run(spark, rows))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert Q.rules(docs).count() == 0


def test_very_long_text(spark):
    text = prose(1, 200_000) + " " + "again and again " * 20_000
    docs = spark.createDataFrame([(0, text, "en", "a")], "doc_id long, text string, lang string, source string")
    r = Q.rules(docs).first()
    assert tuple(r[c] for c in Q.COUNTS) == brute_counts(text)[0]


def test_sketches_merge_by_adding(spark):
    rows = [(i, *x) for i, x in enumerate(made_up())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")

    def one(d):
        measured, names = Q.measure(d)
        return Q.sketches(Q.stage(measured.drop("text")), names)

    whole = {tuple(r)[:4]: r["n"] for r in one(docs).collect()}
    parts = Counter()
    for k in range(3):
        for r in one(docs.where(f"doc_id % 3 = {k}")).collect():
            parts[tuple(r)[:4]] += r["n"]
    assert whole == dict(parts)
