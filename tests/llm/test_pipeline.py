import corpus_pipeline as P
from tests.conftest import SF_SMALL
from tests.llm.data import prose
from valora.llm import decontaminate, language_id
from valora.sources.tables import table


def test_stages_and_run(spark):
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_dedup", "decontamination", "mixing", "sharding"]
    docs = table(spark, SF_SMALL, "documents")
    rows = P.run(spark, SF_SMALL).collect()
    assert set(docs.columns) | {"shard", "slot"} == set(rows[0].asDict())
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == len(set(ids))
    # clean texts stay: what goes was rejected, a near copy of a kept one, or a leak
    from valora.llm import simhash
    from tests.llm.test_simhash import brute, plain
    all_ = docs.orderBy("doc_id").collect()
    rejected = {r["doc_id"] for r in language_id.predict(docs, language_id.fit_documents(docs)).where("rejected").collect()}
    left = [r for r in all_ if r["doc_id"] not in rejected]
    first = set(brute([plain(r["text"]) for r in left], [r["doc_id"] for r in left]))
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(docs, table(spark, SF_SMALL, "benchmark")).collect()}
    assert set(ids) == first - leaks
    assert simhash.SHINGLE == 3
    size = {s: sum(len(r["text"].encode()) + 1 for r in rows if r["shard"] == s) for s in range(8)}
    longest = max(len(r["text"].encode()) for r in rows)
    assert max(size.values()) - min(size.values()) <= 2 * longest


KIND = "doc_id long, text string, lang string, source string, n_chars long, shard string, mix_slot int"


def odd_tables(spark, folder, rows):
    spark.createDataFrame(rows, KIND).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, prose(500, 20)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_odd_rows(spark, tmp_path):
    """Null, empty and very long texts, nulls in all other columns, repeated
    rows and columns named like those that stages add."""
    row = lambda i, t, lang="en", source="a": (i, t, lang, source, len(t or ""), f"s{i}", i)
    rows = [row(i, prose(i, 60 + i), source=f"src{i % 3}") for i in range(40)]
    rows += [row(100, None), row(101, ""), row(102, " \n"), row(103, prose(7, 60_000)), row(104, prose(900, 70), None, None), (None,) * 7]
    rows += [rows[3], rows[3], row(105, prose(31, 10) + " " + prose(500, 20) + " " + prose(32, 30))]
    odd_tables(spark, str(tmp_path), rows)
    out = P.run(spark, str(tmp_path))
    assert out.columns[:7] == [c.split()[0] for c in KIND.split(", ")] and len(out.columns) == 9
    got = out.collect()
    ids = sorted(r["doc_id"] for r in got)
    # texts without a letter have no language, copies and the leak go, all others stay
    assert ids == [*range(40), 103, 104]
    assert all(r["shard"] == f"s{r['doc_id']}" and r["mix_slot"] == r["doc_id"] for r in got)
    shard, slot = out.columns[7:]
    assert {r[shard] for r in got} <= set(range(8))
    for s in range(8):
        assert sorted(r[slot] for r in got if r[shard] == s) == list(range(sum(r[shard] == s for r in got)))


def test_empty_table(spark, tmp_path):
    odd_tables(spark, str(tmp_path), [])
    assert P.run(spark, str(tmp_path)).count() == 0


def test_every_query_is_registered():
    import __spark_entry__ as E
    names = E.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
