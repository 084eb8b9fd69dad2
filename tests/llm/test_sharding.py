import pytest

from tests.llm.data import documents, prose
from valora.llm import sharding as S


def check(rows, shards, worst):
    size = [sum(len((r["text"] or "").encode()) + 1 for r in rows if r["shard"] == s) for s in range(shards)]
    assert max(size) - min(size) <= worst
    for s in range(shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_near_equal_bytes_with_a_hot_text(spark, monkeypatch):
    texts = [prose(i, 5 + i % 60) for i in range(300)] + ["same text " * 20] * 200 + [None, "", None, "é"]
    docs = documents(spark, texts, clash="slot")
    for bucket_rows in (500_000, 20, 4):
        monkeypatch.setattr(S, "BUCKET_ROWS", bucket_rows)
        out = S.shard(docs).withColumnRenamed("slot", "old").withColumnRenamed("_slot", "slot")
        rows = out.collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
        check(rows, 8, 900)
        # equal texts stand together in the order of the shards
        at = [i for i, r in enumerate(sorted(rows, key=lambda r: (r["shard"], r["slot"]))) if r["text"] == texts[300]]
        assert at == list(range(at[0], at[0] + 200))


def test_equal_rows_long_text_and_empty_table(spark):
    docs = documents(spark, ["a", "x" * 2_000_000, None])
    docs = docs.union(docs)
    rows = S.shard(docs, shards=4).collect()
    assert len(rows) == 6
    check(rows, 4, 4_000_100)
    assert S.shard(docs.limit(0)).count() == 0


def test_stored_order(spark, tmp_path):
    docs = documents(spark, [prose(i, 20) for i in range(200)]).orderBy("doc_id")
    docs.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "d"))
    rows = S.in_shards(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))] == list(range(200))


def test_buckets_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_BYTES", 20_000)
    docs = documents(spark, [prose(i, 2_000 if i % 9 == 0 else 20) for i in range(180)])
    out = S.shard(docs)
    check(out.collect(), 8, 30_000)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert " div 1 " not in plan and "bucket" in plan  # more than one bucket a shard


def test_rows_without_a_stored_order_are_sharded_with_a_warning(spark):
    docs = documents(spark, [prose(i, 20) for i in range(50)])
    with pytest.warns(UserWarning, match="no stored order"):
        assert S.in_shards(docs).count() == 50
