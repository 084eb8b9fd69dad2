import math

import pytest

from tests.llm.data import documents
from valora.llm import mixing as M


def stream(rows):
    return [r["source"] for r in sorted(rows, key=lambda r: (r["mix_slot"], r["mix_item"]))]


def test_every_document_once_and_less_than_a_block_off(spark):
    texts = [f"t{i}" for i in range(300)] + [None, "", "t0", "x" * 1_000_000]
    docs = documents(spark, texts, clash="mix_slot").withColumnRenamed("mix_slot", "k").unionByName(
        documents(spark, texts[:2], clash="k"))
    weights = {"src0": 0.2, "src1": 0.5, "src2": 0.25, None: 0.05}
    out = M.mix(docs, weights, block_rows=1)
    assert out.columns == [*docs.columns, "mix_block", "mix_slot", "mix_item"]
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted([*range(len(texts)), 0, 1])
    order = stream(rows)
    assert sorted(r["mix_slot"] for r in rows) == list(range(len(rows)))
    total = {s: order.count(s) for s in weights}
    until = min(total[s] / w for s, w in weights.items())  # all sources have documents
    seen = dict.fromkeys(weights, 0)
    for t, s in enumerate(order[: int(until)], 1):
        seen[s] += 1
        assert all(abs(seen[k] - w * t) < 1 for k, w in weights.items())


def test_phases_hold_the_remaining_weights():
    blocks, weights = {"a": 900, "b": 50, "c": 2000, "d": 7}, {"a": 3.0, "b": 1.0, "c": 2.0}
    plan = M.phases(blocks, weights)
    slot = {}
    for s, runs in plan.items():
        at = 0
        for first, end, start, n, slots in runs:
            assert first == at
            at = end
            for b in range(first, end):
                q, j = divmod(b - first, len(slots))
                slot[start + q * n + slots[j]] = s
        assert at == blocks[s]
    assert sorted(slot) == list(range(sum(blocks.values())))
    order = [slot[t] for t in range(len(slot))]
    assert set(order[-7:]) == {"d"}  # no weight: after all others
    left, done, begin = dict(blocks), dict.fromkeys(blocks, 0), 0
    for t, s in enumerate(order):
        active = {k: weights[k] for k in left if left[k] and k in weights}
        if s in active and t - begin < 5000:
            done[s] += 1
        left[s] -= 1
        share = M.parts(active) if active else {}
        for k, c in share.items():
            assert abs(done[k] - c / M.RESOLUTION * (t + 1 - begin)) < 1
        if not left[s]:
            begin, done = t + 1, dict.fromkeys(blocks, 0)


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1, "c": 1}, {str(i): 1 / (i + 1) for i in range(40)}, {"a": 999, "b": 0.001}])
def test_every_block_runs_between_release_and_deadline(weights):
    share = M.parts(weights)
    assert sum(share.values()) == M.RESOLUTION
    for s, slots in M.period(share).items():
        c, n = share[s], M.RESOLUTION
        assert all(i * n // c <= t < math.ceil((i + 1) * n / c) for i, t in enumerate(slots))


def test_default_weights_stored_order_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 2)
    docs = documents(spark, [f"t{i}" for i in range(100)])
    mixed = M.in_order(docs)
    assert mixed.columns == docs.columns and mixed.count() == 100
    assert M.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        monkeypatch.setattr(M, "MAX_SOURCES", 2)
        M.mix(docs)


def test_deviation_from_the_true_weights():
    root = {f"r{i:02}": 200_000 + 3_500 * i for i in range(20)} | {"hot": 2_000_000}
    root = {k: (n // 80, math.sqrt(n)) for k, n in root.items()}
    tiny = {f"t{i:03}": (1, 0.01 / 900) for i in range(900)} | {"hot": (60_000, 0.99)}
    for case in (root, tiny):
        total = sum(w for _, w in case.values())
        plan = M.phases({k: n for k, (n, _) in case.items()}, {k: w for k, (_, w) in case.items()})
        until = min(n * total / w for n, w in case.values())  # all sources have blocks
        for k, (n, w) in case.items():
            slots = [start + (b - first) // len(s) * p + s[(b - first) % len(s)]
                     for first, end, start, p, s in plan[k] for b in range(first, end)]
            assert len(slots) == n
            for i, t in enumerate(slots):
                if t + 1 < until:  # just before and just after the block
                    assert abs(i - w / total * t) < 1 and abs(i + 1 - w / total * (t + 1)) < 1


def test_any_number_of_sources_and_plan_in_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "STEP", 500)
    monkeypatch.setattr(M, "PIECE", 16)
    monkeypatch.setattr(M, "BROADCAST_BLOCKS", 0)
    docs = spark.range(3000).selectExpr("id doc_id", "'t' text", "if(id < 1800, concat('s', id), if(id < 2900, 'hot', null)) source")
    rows = M.mix(docs, block_rows=1).collect()
    assert sorted(r["mix_slot"] for r in rows) == list(range(3000))
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
