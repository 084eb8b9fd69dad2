import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from valora.llm import collocations as C


def phrases(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
        words = re.findall(r"[^\x20\x09]+", piece)
        for i in range(len(words)):
            for k in range(1, min(C.LONGEST, len(words) - i) + 1):
                yield " ".join(words[i: i + k]), k


def brute(rows, min_count, top, percent):
    f, total, out = {}, Counter(), []
    for text, lang in rows:
        for p, k in phrases(text):
            f.setdefault(lang or "und", Counter())[p] += 1
            total[lang or "und"] += k == 1
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= min_count}
        best = []
        for p, a in often.items():
            w = p.split(" ")
            if len(w) < 2 or any(len(q.split(" ")) > len(w) and f" {p} " in f" {q} " and 100 * b >= percent * a
                                 for q, b in often.items()):
                continue
            cuts = []
            for k in range(1, len(w)):
                left, right = counts[" ".join(w[:k])], counts[" ".join(w[k:])]
                cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            best.append((-score, -a, p.encode(), (p, a, left, right, total[lang], score)))
        out += [(lang, i, *row) for i, (_, _, _, row) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def made_up(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéÉX") for _ in range(r.randrange(1, 4))) for _ in range(40)]
    gaps = [" "] * 14 + ["  ", "\t", ". ", ",", "\n", " ;:", "! "]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice(gaps) for _ in range(n))
    hot = text(60)
    rows = [(text(r.randrange(0, 80)), r.choice(["en", "en", "de", None, "und"])) for _ in range(250)]
    rows += [(hot, "en")] * 120 + [(text(20) + hot[: r.randrange(40, 150)], "de") for _ in range(60)]
    rows += [(None, "en"), ("", None), (" \t.", "xx"), ("a\x00b a\x00b", "zz"), ("same " * 500, "en"), (("x y " * 300) + "z", "fr")]
    return rows + rows[:20]


@pytest.mark.parametrize("bits", [C.FILTER_BITS, 64])  # 64: the filters let nearly everything through
def test_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(C, "FILTER_BITS", bits)
    rows = made_up(2)
    docs = spark.createDataFrame([(i, *x, 1, 2) for i, x in enumerate(rows)], "doc_id long, text string, lang string, n int, salt int")
    for min_count, top, percent in ((4, 2000, 100), (3, 25, 60)):
        got = C.collocations(docs.repartition(3), min_count=min_count, top=top, drop_percent=percent).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, min_count, top, percent)


def chunks_of(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    return Counter((r["chunk"], r["shared"], r["own"]) for b in C._parse_batches([batch]) for r in b.to_pylist())


@pytest.mark.parametrize("slice_bytes,max_core,mod", [(1 << 20, 256, 16), (300, 7, 16), (60, 5, 2), (20, 5, 16)])
def test_every_phrase_begins_in_one_chunk_that_holds_it(monkeypatch, slice_bytes, max_core, mod):
    monkeypatch.setattr(C, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(C, "MAX_CORE", max_core)
    monkeypatch.setattr(C, "MOD", mod)
    for seed in range(5):
        texts = [t for t, _ in made_up(seed)][:80]
        have = Counter()
        for (chunk, shared, own), n in chunks_of([t for t in texts if t is not None]).items():
            words = chunk.decode().split(" ")
            assert len(words) == own + (C.OVERLAP if shared else 0) and own <= max_core + C.OVERLAP
            for i in range(own):
                for k in range(1, min(C.LONGEST, len(words) - i) + 1):
                    have[" ".join(words[i: i + k])] += n
        assert have == Counter(p for t in texts for p, _ in phrases(t))


def test_counts_given_out_early_add_up(monkeypatch):
    some = sorted(chunks_of([t for t, _ in made_up(7) if t]).items())
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["en"] * len(some)), pa.array([c for (c, _, _), _ in some], pa.binary()),
         pa.array([own for (_, _, own), _ in some], pa.int32()), pa.array([n for _, n in some], pa.int64())], ["lang", "chunk", "own", "n"])

    def counted():
        hashes, words = Counter(), Counter()
        for b in C._count_hashes({}, range(1, C.LONGEST + 1))([batch]):
            for r in b.to_pylist():
                hashes[r["k"], r["h"]] += r["n"]
        for b in C._count_phrases({}, range(1, C.LONGEST + 1))([batch]):
            for r in b.to_pylist():
                words[r["phrase"]] += r["n"]
        return hashes, words

    whole = counted()
    assert len(whole[0]) == len(whole[1])
    monkeypatch.setattr(C, "HELD", 50)
    assert counted() == whole


def test_equal_passages_give_equal_chunks():
    r = random.Random(4)
    passage = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400))
    alone = chunks_of([passage])
    inside = chunks_of([f"some words before {passage} and some more after" for _ in range(3)])
    assert sum(n == 3 for n in inside.values()) == len(inside)
    assert len(set(alone) & set(inside)) >= len(alone) - 2


def test_numbers_beyond_64_bits(spark):
    counts = spark.createDataFrame([(3_000_000_000_000, 7_000_000_000_000, 3_000_000_000_001, 3_000_000_000_003)],
                                   "a long, n long, l long, r long")
    (a, n, left, right), = counts.collect()
    assert counts.selectExpr(C.SCORE).first()[0] == 1000 * a * n // (left * right)


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
