"""Session settings every job relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin the run-time settings that results or plans depend on.

    Only SQL run-time settings are touched, so this is safe on a session the
    cluster created. Shuffle partition counts and broadcast limits stay as the
    cluster set them: adaptive execution sizes both from real shuffle statistics,
    which is also what decides between a broadcast and a shuffled join.
    """
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # Windows and Arrow stages are CPU-bound: keep small shuffles spread over the cores.
    # Large ones are sized by total bytes / parallelism and the advisory size as usual.
    conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
    # The JVM never compiles methods above 8,000 bytecodes; wide projections would run
    # interpreted inside one fused method, so let Spark split those instead.
    conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    # Timestamps are instants in UTC, whatever the writer flagged; a cast after the read
    # would keep time filters out of the scan.
    conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    return spark


def local_session(cores: str = "*", app: str = "tapeline", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names.

    A machine-local folder is made only when nothing is configured, which is the
    case in local tests and never on a cluster.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="tapeline-")
