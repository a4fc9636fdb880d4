"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def get_session(
    master: str | None = None, app: str = "cohortlab", shuffle_partitions: int | None = None, driver_memory: str | None = "8g"
) -> SparkSession:
    """Build (or reuse) a session with AQE and skew-join handling switched on.

    On a cluster pass ``master=None``; the launcher decides.  The web UI stays off.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory and master and master.startswith("local"):
        # local mode: the driver JVM is also the executor (only takes effect before the JVM starts)
        b = b.config("spark.driver.memory", driver_memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used as is.  Only when a
    *local* session has none (tests) a scratch folder is created and set; on a
    cluster every executor would write to its own disk there, so that raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    configured = spark.conf.get("spark.checkpoint.dir", None)
    path = configured or current
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="cohortlab-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not current:
        sc.setCheckpointDir(path)
    return path


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


@contextlib.contextmanager
def bounded_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """For rows so large that few fill a batch: plans run within it write row groups of ``most`` bytes (a reader holds a whole one) and hand
    Python batches of ``most`` bytes, or of the session's own bound, if that is smaller."""
    arrow = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = int(spark.conf.get(arrow).rstrip("bB"))
    new = {"parquet.block.size": most, "parquet.page.size.row.check.min": 1, arrow: own if 0 < own <= most else most}
    before = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_path(spark: SparkSession, kind: str, name: str) -> str:
    """A new path under the shared folder; the run id keeps callers from overwriting each other."""
    return "/".join([ensure_checkpoint_dir(spark).rstrip("/"), kind, f"{name}_{uuid.uuid4().hex[:12]}"])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` under the shared checkpoint folder and reading it back.

    A written table survives executor loss (unlike a cached or locally
    checkpointed frame) and later stages read it with pushdown and pruning.
    """
    spark = df.sparkSession
    path = run_path(spark, "tables", name)
    df.write.parquet(path)
    return spark.read.parquet(path)
