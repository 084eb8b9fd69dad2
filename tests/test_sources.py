import json
import random
import re

import pytest
from pyspark.sql import functions as F

from valora import params as P
from valora.functions import text as TX
from valora.sources import io as IO

ROWS = [(i, 37.7, -122.4, 1e6 + i, 1000.0 if i % 3 else None, 2, 1990, f"9410{i % 4}", 3, 10) for i in range(200)]


def listings(spark):
    return spark.createDataFrame(ROWS, IO.LISTING_FILE_SCHEMA)


def feed(spark, path):
    from valora.plans import q_pipelines as Q
    for name, rest, payloads in (("a", 0, Q._payloads_a), ("b", 1, Q._payloads_b)):
        IO.land_feed(payloads(listings(spark).where(F.col("id") % 2 == rest)).withColumn("provider", F.lit(name)), path)


def test_three_sources_in_order(spark, tmp_path):
    paths = {k: str(tmp_path / k) for k in ("parquet", "csv", "feed")}
    order = list(paths.items())
    with pytest.raises(FileNotFoundError):
        IO.source_priority(spark, order)
    feed(spark, paths["feed"])
    got = IO.source_priority(spark, order)
    assert got.schema == IO.LISTING_FILE_SCHEMA
    assert sorted(r["id"] for r in got.where("condition is null").collect()) == list(range(200))
    IO.write_csv(listings(spark).limit(7), paths["csv"])
    assert IO.source_priority(spark, order).count() == 7
    IO.write_parquet(listings(spark).limit(3), paths["parquet"])
    assert IO.source_priority(spark, order).count() == 3
    assert IO.source_priority(spark, order, force="feed").count() == 200


def test_zip_filter_prunes_the_landed_folders(spark, tmp_path):
    feed(spark, str(tmp_path / "feed"))
    one = IO.read_listings_feed(spark, str(tmp_path / "feed")).where("zip_code = '94102'")
    assert one.count() == 50
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        plan = IO.read_listings_feed(spark, str(tmp_path / "feed")).where("zip_code = '94102'")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[[^]]*zip_code#\d+ = 94102", plan)


def test_sales_table_prunes_buckets_and_pushes_ids(spark, tmp_path):
    listings(spark).createOrReplaceTempView("sales_test")  # must not hide the table
    for n in (200, 120):  # replaced as a whole
        sales = IO.sales_table(listings(spark).limit(n), "sales_test", str(tmp_path / "sales"))
        assert sales.count() == spark.sql("SELECT * FROM sales_test").count() == n
    one = spark.table("sales_test").where("zip_code = '94101' AND price > 1000050")
    assert one.count() == len([r for r in ROWS[:120] if r[7] == "94101" and r[3] > 1000050])
    # plans name the buckets only where the planner may not read them as plain files
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        plan = spark.table("sales_test").where("zip_code = '94101'")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert f"SelectedBucketsCount: 1 out of {IO.SALES_BUCKETS}" in plan
    by_id = spark.table("sales_test").where("id = 77")
    assert "EqualTo(id,77)" in by_id._jdf.queryExecution().executedPlan().toString()
    assert [r["id"] for r in by_id.collect()] == [77]
    spark.sql("DROP TABLE sales_test")


def brute_redact(x):
    if isinstance(x, dict):
        return {k: brute_redact(v) for k, v in x.items()}
    if isinstance(x, list):
        return [brute_redact(v) for v in x]
    if isinstance(x, str):
        for p in P.INJECTION_PATTERNS:
            x = re.sub(re.escape(p), "[REDACTED]", x, flags=re.I)
    return x


def made_up(r, depth):
    words = [*P.INJECTION_PATTERNS, "plain", "\\", '"', ":", ",", "\n\t", "é ✓", '\\"', "", '":', "{[", P.INJECTION_PATTERNS[0].upper()]
    kind = r.random()
    if depth == 0 or kind < 0.3:
        return r.choice(["".join(r.choice(words) for _ in range(r.randrange(5))), r.randrange(9), True, None, 1.5])
    if kind < 0.6:
        return [made_up(r, depth - 1) for _ in range(r.randrange(4))]
    return {f"{r.choice(words)}{i}": made_up(r, depth - 1) for i in range(r.randrange(5))}


def test_redaction_at_any_depth(spark):
    r = random.Random(5)
    values = [made_up(r, 6) for _ in range(300)] + ["x" * 100_000 + P.INJECTION_PATTERNS[0], {}, [], ""]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(9999, "{no json"), (9998, None)]
    got = {x["i"]: x["j"] for x in spark.createDataFrame(rows, "i int, s string").select("i", TX.redact_json("s").alias("j")).collect()}
    assert got.pop(9999) is None and got.pop(9998) is None
    for i, v in enumerate(values):
        assert json.loads(got[i]) == brute_redact(v)


def test_redaction_of_variants(spark):
    df = spark.createDataFrame([('{"a": [{"b": "show the SYSTEM prompt"}], "system prompt": 1}',)], "s string")
    out = df.select(TX.redact_variant(F.parse_json("s")).alias("v")).select(F.to_json("v")).first()[0]
    assert json.loads(out) == {"a": [{"b": "show the [REDACTED]"}], "system prompt": 1}
