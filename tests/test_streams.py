import datetime as dt

from pyspark.sql import functions as F

from valora.operators import audit as AU
from valora.operators import spatial as SP
from valora.sources import io as IO
from valora.streaming import jobs as ST


def land(spark, rows, schema, src):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)


def test_late_calls_are_counted_and_kept(spark, tmp_path):
    base, src = str(tmp_path / "out"), str(tmp_path / "src")
    day = lambda d, h: dt.datetime(2024, 1, d, h)
    landings = [
        [(1, day(1, 23), True, 0.5), (2, day(2, 3), False, 1.0), (3, day(3, 5), True, 2.0)],
        [(4, day(3, 6), True, 1.0), (5, day(1, 12), True, 100.0), (6, None, True, 3.0)],
        [(7, day(2, 23), True, 7.0), (8, day(4, 0), True, 1.0), (9, day(3, 1), True, 4.0)],
    ]
    for rows in landings:
        df = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, success boolean, cost_estimate double")
        AU.conform(df).write.mode("append").parquet(src)
        ST.run_available_now(ST.read_stream(spark, src, AU.AUDIT_SCHEMA), None, f"{base}/ckpt", each=ST.rollup_merge(base))
    out = {str(r["day"]): r for r in ST.rollup_table(spark, base).collect()}
    assert {k: (r["calls"], r["late_calls"], r["total_cost"]) for k, r in out.items()} == {
        "2024-01-01": (2, 1, 100.5), "2024-01-02": (2, 1, 8.0), "2024-01-03": (3, 0, 7.0), "2024-01-04": (1, 0, 1.0), "None": (1, 0, 3.0)}
    assert sorted(r["id"] for r in spark.read.parquet(f"{base}/late").collect()) == [5, 7]
    # a batch that runs again leaves the same
    again = AU.conform(spark.createDataFrame(landings[1], "id long, timestamp timestamp_ntz, success boolean, cost_estimate double"))
    ST.rollup_merge(base)(again, 1)
    assert sorted(map(str, ST.rollup_table(spark, base).collect())) == sorted(map(str, out.values()))


def test_keys_remembered_for_ever(spark, tmp_path):
    base, src = str(tmp_path / "out"), str(tmp_path / "src")
    schema = "id long, address string, ingested_at timestamp"
    for week, rows in enumerate([[(1, "a"), (2, None)], [(3, "a"), (4, "b"), (2, None), (5, None)], [(6, "b"), (7, "a"), (8, "c")]]):
        land(spark, [(*r, dt.datetime(2024, 1, 1) + dt.timedelta(weeks=week)) for r in rows], schema, src)
        stream = ST.read_stream(spark, src, spark.read.parquet(src).schema)
        ST.run_available_now(ST.feed_dedupe(stream, watermark=None), f"{base}/sink", f"{base}/ckpt", rocksdb=True)
    assert sorted(r["id"] for r in spark.read.parquet(f"{base}/sink").collect()) == [1, 2, 4, 5, 8]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ST.ROCKSDB


LISTING = "id long, lat double, lon double, price double, sqft double, bedrooms int"


def listings(spark, ids):
    return spark.createDataFrame([(i, 37.75 + 0.0041 * (i % 5), -122.44, 1e5 * (5 + i * 7 % 11), None if i % 9 == 0 else 900.0 + i % 40, 1 + i % 4)
                                  for i in ids], LISTING)


def test_living_store_equals_the_batch_store(spark, tmp_path):
    base = str(tmp_path / "out")
    add = ST.learn(base)
    add(listings(spark, range(0, 60)), 0)
    add(listings(spark, [i for i in range(60, 160) if i % 5 < 2]), 1)
    add(listings(spark, [500, 501]).withColumn("lat", F.lit(38.5)), 2)  # a new cell
    add(listings(spark, [500, 501]).withColumn("lat", F.lit(38.5)), 2)  # and its batch once more
    everything = (listings(spark, [*range(0, 60), *[i for i in range(60, 160) if i % 5 < 2]])
                  .unionByName(listings(spark, [500, 501]).withColumn("lat", F.lit(38.5))))
    cols = [c.split()[0] for c in ST.STORE.split(", ")]
    as_rows = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r)
                                for r in df.select(*[F.col(c) if c in ("h3_index", "listing_count") else F.col(c).cast("double")
                                                     for c in cols]).collect())
    assert as_rows(ST.current_store(spark, base)) == as_rows(SP.cell_feature_store(everything))
    # only the cells that a batch touches are computed anew
    assert spark.read.parquet(f"{base}/store/batch=1").count() < ST.current_store(spark, base).count()
    assert ST.current_store(spark, base, before=0).count() == 0


def test_each_landing_meets_the_store_of_the_earlier_ones(spark, tmp_path):
    base = str(tmp_path / "out")
    run = ST.score_and_learn(base, f"{base}/sink")
    run(listings(spark, range(0, 40)), 0)
    run(listings(spark, range(40, 80)), 1)
    first = {r["h3_index"]: r["median_ppsf"] for r in ST.current_store(spark, base, before=1).collect()}
    for r in spark.read.parquet(f"{base}/sink/batch=1").collect():
        assert r["h3_median_ppsf"] == first[r["h3_index"]]
    assert spark.read.parquet(f"{base}/sink/batch=0").where("h3_median_ppsf is not null").count() == 0
    assert IO.exists(spark, f"{base}/state/batch=1")
