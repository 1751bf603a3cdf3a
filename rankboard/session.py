"""Session construction and the shared folder used for lineage cuts and sinks."""

from __future__ import annotations

import re
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Streaming state (per-user running totals) lives in RocksDB, off the JVM heap,
# with changelog checkpointing so each trigger uploads only what changed.
STREAMING_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# Settings every job relies on.  AQE re-plans joins from runtime sizes (a join
# side is broadcast only when its *measured* size is under the threshold) and
# splits skewed shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # size-driven coalescing: on a cluster set shuffle.partitions high, AQE merges
    # small partitions up to the advisory size instead of keeping them all
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    **STREAMING_CONF,
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "rankboard", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    On a cluster, call with ``master=None`` so the launcher's settings win.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark   # the shared folder is resolved lazily, by the jobs that write there


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    The folder named by the cluster is used as is.  Where none is named, a folder
    beside the session's tables (``spark.sql.warehouse.dir``, which driver and
    executors share) is set; never a machine-local one on a cluster (that raises).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        local = re.match(r"file:|(?![A-Za-z][A-Za-z0-9+.-]*:)", warehouse)
        if local and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"the warehouse {warehouse} is a folder of one machine: set spark.checkpoint.dir to a shared one")
        conf_dir = f"{warehouse}/_rankboard_shared"
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shared_path(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A path under the shared folder, for sink tables, exports and stream checkpoints."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    base = base.rstrip("/")
    leaf = "/".join(parts) if parts else "work"
    if unique:
        leaf = f"{leaf}-{uuid.uuid4().hex[:12]}"
    return f"{base}/rankboard/{leaf}"


_scopes = threading.local()


def release_path(spark: SparkSession, path: str) -> None:
    """Free a directory's storage with public API only: overwrite it with an empty write."""
    spark.range(0).write.mode("overwrite").parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a directory that this library has written; one that is gone already is fine."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def lineage_scope(spark: SparkSession):
    """Release every lineage cut written inside the block when the block ends.

    Wrap work that materialises its result (a publish, a write, a collect); a
    lazy DataFrame returned out of the block would read released files.
    """
    stack = getattr(_scopes, "stack", None)
    if stack is None:
        stack = _scopes.stack = []
    paths: list[str] = []
    stack.append(paths)
    try:
        yield paths
    finally:
        stack.pop()
        for p in paths:
            try:
                release_path(spark, p)
            except Exception:  # noqa: BLE001 - cleanup must not mask the block's outcome
                pass


def cut_lineage(df, label: str = "stage", path: str | None = None):
    """Write ``df`` as parquet under the shared folder and read it back.

    Used where two passes must see identical data (e.g. after a sampled range
    partitioning): the files are immutable, so a lost executor only re-reads
    them, and parquet is columnar and compressed, unlike RDD checkpoint files.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, "lineage", label)
    df.write.mode("overwrite").parquet(path)
    stack = getattr(_scopes, "stack", None)
    if stack:
        stack[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)
