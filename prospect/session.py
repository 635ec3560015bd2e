"""Session helpers: a local session for tests and the bench, and the shared
folder used for checkpoints and scratch output.

On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared file
system every executor can reach).  Only a local-mode session without that
setting gets a private folder under the system temporary directory.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "prospect") -> SparkSession:
    """Session used by tests and ``bench.py`` (local mode, UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for checkpoints and scratch tables.

    Reads ``spark.checkpoint.dir`` (or a directory already set on the
    context).  A local-mode session without one gets a fresh temporary
    folder; a cluster session without one is a configuration error, because
    a machine-local folder is not visible to the other executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, S3, ...) for this cluster")
        configured = tempfile.mkdtemp(prefix="prospect-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


#: The innermost open scope of this thread or task; it alone owns new paths.
_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch_scope", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder (never reused); owned by
    the innermost open ``scratch_scope`` of the caller."""
    base = shared_dir(spark).rstrip("/")
    path = f"{base}/prospect-scratch/{name}-{uuid.uuid4().hex[:12]}"
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    return path


def _delete_paths(spark: SparkSession, paths: list[str]) -> int:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        if fs.exists(hp):
            fs.delete(hp, True)
            removed += 1
    return removed


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Delete, on exit, the scratch tables created inside the block
    (materialized stages).  Results are lazy and may read those tables, so
    write or collect every output inside the block."""
    created: list[str] = []
    before = _SCOPE.set(created)
    try:
        yield created
    finally:
        _SCOPE.reset(before)
        _delete_paths(spark, created)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing ``df`` as a Parquet table in the shared folder
    and reading it back.

    The plan runs once (an eager ``checkpoint()`` runs it twice: once to
    count, once to write), the table survives executor loss (unlike
    ``localCheckpoint``), and the re-read carries real file sizes for the
    optimizer's broadcast decisions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialize_counted(df: DataFrame, name: str = "stage") -> tuple[DataFrame, int]:
    """``materialize`` plus the number of rows written, observed during the
    write itself (no second job to count)."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    spark = df.sparkSession
    path = scratch_path(spark, name)
    obs = Observation(f"rows-{name}")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), int(obs.get["rows"])


def broadcast_row_limit(spark: SparkSession, row_bytes: int) -> int:
    """Rows of ``row_bytes`` each that fit under the broadcast threshold."""
    limit = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())  # in bytes, any unit
    if limit <= 0:
        return 0
    return max(1, limit // max(1, row_bytes))


def size_estimate(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` in bytes (from file sizes for
    scans; an upper bound through filters, projections and aggregates; 0 if
    unknown).  Not meaningful above a join: without column statistics a
    join is estimated as the product of its inputs, so size the input."""
    try:
        est = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - estimates are advisory
        return 0
    # Without statistics Spark reports spark.sql.defaultSizeInBytes (Long.MaxValue).
    return 0 if est >= 1 << 60 else est


def output_partitions(df: DataFrame, target_bytes: int = 256 * 1024 * 1024) -> int:
    """Partitions for writing ``df``: about ``target_bytes`` each by the size
    estimate, and never fewer than the cluster's default parallelism, so each
    task's sort fits in memory or spills in bounded runs."""
    spark = df.sparkSession
    parallel = max(1, spark.sparkContext.defaultParallelism)
    est = size_estimate(df)
    wanted = -(-est // max(1, target_bytes)) if est > 0 else parallel
    return int(min(max(parallel, wanted), (1 << 31) - 1))
