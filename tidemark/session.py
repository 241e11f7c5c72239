"""Session helpers.

Library code never builds its own session: every job takes the caller's
``SparkSession``. ``local_session`` is for tests, the bench and examples only.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tidemark", extra: dict | None = None) -> SparkSession:
    """A local session with the settings the tests assume (UTC, AQE, no UI)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.driver.memory", "8g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's reliable checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only where it is unset (local tests, the driver's smoke check) a
    private folder is created here and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for staged tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"stage-{name}-{uuid.uuid4().hex[:12]}")


def stage_table(df, name: str = "stage"):
    """Materialise ``df`` once as a Parquet table in the checkpoint folder and
    return a reader over it.

    Like a reliable checkpoint this cuts lineage (a lost executor re-reads
    the table instead of recomputing the plan) and gives every later reader
    one snapshot; unlike an RDD checkpoint, later readers get column pruning
    and pushed-down filters on the staged data, and writing it is cheaper.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    return spark.read.parquet(path)


#: The staged folders of the job that runs in this thread.
_SCOPE: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def staging_scope(spark: SparkSession):
    """Within it, ``stage_table`` folders belong to this job alone and are
    deleted at its end (once nothing reads them any more)."""
    mine: list[str] = []
    token = _SCOPE.set(mine)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in mine:
            hp = jvm.org.apache.hadoop.fs.Path(path)
            hp.getFileSystem(conf).delete(hp, True)
