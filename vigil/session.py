"""SparkSession construction and cluster-safe settings.

On a cluster the session is created by the platform; ``configure`` only
fills in settings that are unset, so cluster values always win.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings this library relies on. Applied only where the session has no value.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply DEFAULTS where unset; never override the cluster's choices."""
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, shuffle_partitions: int | None = None,
                  app: str = "vigil") -> SparkSession:
    """Local session for tests and the bench (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a local one only in local mode.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3/...) folder
    and is used as is; without one an error is raised, since executors could
    not read a folder of the driver's machine. Only ``local[...]`` sessions
    where nothing is configured get a folder under the system temp directory
    (``spark.checkpoint.dir`` is a static setting, so it is registered through
    the SparkContext).
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rsplit("/", 1)[0]
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="vigil-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder that no other run uses."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/vigil-tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def checkpoint_table(spark: SparkSession, df, name: str):
    """Cut lineage by writing ``df`` as parquet under the shared checkpoint
    folder and reading it back. Survives executor loss, unlike a local
    checkpoint. Every call writes to a path of its own, so a plan that reads
    an earlier table of the same name stays valid."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
