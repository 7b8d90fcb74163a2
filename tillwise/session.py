"""Session helpers.

``get_spark`` builds a local session for tests and the bench; on a cluster the
caller brings its own session and every operator only uses ``df.sparkSession``.
``scratch_dir`` resolves the shared folder used to cut lineage: the cluster's
``spark.checkpoint.dir`` when it is set, and a fresh folder only when it is not
(local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              driver_memory: str = "8g", extra: dict | None = None) -> SparkSession:
    """Local session with the settings the operators assume (UTC, AQE on, no UI)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.master(master or f"local[{cpus}]").appName("tillwise")
    conf = dict(_DEFAULT_CONF)
    conf["spark.driver.memory"] = driver_memory
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_settings(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings for a large cluster, sized from the input volume and core count.

    - file splits of ``target_partition_bytes`` (one task reads ~256 MB),
    - initial shuffle partitions between 2 and 4 waves of the cores: map outputs times
      reduce partitions is what the driver has to track, so their number follows the
      cores and not the bytes; AQE coalesces small ones towards 128 MB and splits skewed
      ones, and operators fold lines map-side before they shuffle,
    - AQE skew join: a partition 5x the median and above 512 MB is split, which
      covers a key that holds a large share of the lines in the one line-level join,
    - broadcast only what AQE measured below 64 MB.
    """
    shuffle = min(max(2 * cores, int(input_bytes // target_partition_bytes) + 1), 4 * cores)
    # at most 32 waves of read tasks, so a file split grows with very large inputs
    split = max(target_partition_bytes, int(input_bytes // (32 * cores)))
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.session.timeZone": "UTC",
    }


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and derived tables.

    Uses ``spark.checkpoint.dir`` (or a checkpoint dir already set on the
    context) when present; otherwise sets a new one, which only happens in
    local runs and tests.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or "
                               "an object store); a machine-local folder would not survive "
                               "a lost executor")
        configured = tempfile.mkdtemp(prefix="tillwise-ckpt-")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


#: Paths handed out and not deleted yet, by application.
_WRITTEN: dict[str, list[str]] = {}


def derived_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared scratch folder for a table Spark writes; ``release_scratch`` deletes it."""
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete the derived tables written in this application (those after the first ``since``); call it when the
    results that read them have been written or collected. Returns how many were deleted."""
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    paths, written[since:] = written[since:], []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


@contextmanager
def scratch_scope(spark: SparkSession):
    """``with scratch_scope(spark): ...``: what the block's operators wrote to the scratch folder is deleted at its end, also
    after an error. Write or collect the results inside the block."""
    since = len(_WRITTEN.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release_scratch(spark, since)
