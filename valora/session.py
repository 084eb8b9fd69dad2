"""Spark session helpers.

The library never creates a session behind the user's back: every operator
takes DataFrames.  ``get_spark`` exists for scripts, tests and the bench.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "valora") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("VALORA_DRIVER_MEMORY", "16g"))
        .config("spark.sql.ansi.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/object store)
    folder and is used as is.  A scratch folder is made only where it is unset
    and the master is local; on any other master an unset folder is an error,
    because every executor would write to its own disk.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir() if hasattr(
            spark.sparkContext, "getCheckpointDir") else None
    if not current:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master or 'a cluster'}")
        current = tempfile.mkdtemp(prefix="valora-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    try:
        spark.sparkContext.setCheckpointDir(current)
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        pass
    return current


def stage(df, name: str = "stage", spread: bool = False):
    """Write a multi-use intermediate once and read it back.

    The table goes to the cluster's shared ``spark.checkpoint.dir`` as
    Parquet (columnar: later readers prune columns and push filters), which
    cuts the lineage: every consumer scans the staged files instead of
    re-running the upstream plan, and a lost executor only costs a re-read.
    Staged tables are needed until the consuming job finishes (retention of
    ``<checkpoint dir>/stage`` is the cluster's TTL policy).
    """
    import uuid
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    # ``spread``: a small staged table reads back as one split; spread it
    # over the cluster's parallelism when a fan-out consumer (explode, join)
    # follows.  Large tables already split into >= that many partitions.
    return spread_out(out) if spread else out


def spread_out(df):
    """Repartition round-robin to the cluster's default parallelism when a
    (small) input arrives in fewer partitions -- used before a fan-out
    (explode + join) so the expanded rows are not processed by one task.
    Inputs that already have enough partitions are returned unchanged."""
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(par) if df.rdd.getNumPartitions() < par else df
