"""Session settings the jobs rely on. A cluster's own values for sizes are left alone."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Correctness first (UTC, ANSI casts), then adaptive execution: partition counts, skewed joins and
# broadcast decisions are taken from measured shuffle sizes, not guessed here.
# Keys seen by a stream grow with its log; this store keeps them on disk, not in memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Plans here have many column expressions; recording a call site for each one is slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(app: str = "tidemark", cpus: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
