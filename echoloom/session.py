"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution re-plans joins from measured sizes, splits skewed join
# partitions and merges small ones; forcing the skew split lets it also act
# where that costs one more exchange, which is cheaper than one hot task.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Scratch folders of local sessions that name none, by application.
_LOCAL_ROOTS: dict[str, str] = {}


def local_session(cpus: int | str = "*", app: str = "echoloom", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own; on a cluster
    a machine-local folder would be invisible to the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app in _LOCAL_ROOTS:
        return _LOCAL_ROOTS[app]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="echoloom-")
    return _LOCAL_ROOTS[app]


# The shuffles of a job end with it: their files go at once, not when the driver next collects garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table that a job reads more than once to the scratch folder.

    Later passes read only the columns they need, and a lost executor costs a
    re-read instead of the work upstream. Shuffle files of the write are removed
    after it.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """Store a table in sorted buckets of ``key``: joins on it then read it without a shuffle.

    Buckets need a table name while they are written; the name goes at once, the files and what the frame knows of them
    stay.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", scratch_dir(spark, label)).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return stored


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A path below the scratch folder that no earlier run used."""
    return os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")
