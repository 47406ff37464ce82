"""Session helpers: building a session and locating the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_DEFAULT_DIR: str | None = None


def build_session(master: str | None = None, app: str = "tesserae", shuffle_partitions: int | None = None,
                  extra: dict | None = None, input_bytes: int | None = None, cores: int | None = None) -> SparkSession:
    """Session with the settings every operator here assumes (AQE on, UTC).

    With ``input_bytes`` and ``cores`` the shuffle and scan settings come
    from ``sizing`` (partitions of ~256 MB of input)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if input_bytes and cores:
        conf.update(sizing(input_bytes, cores))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def sizing(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Shuffle and scan settings for a job reading ``input_bytes`` on
    ``cores`` executor cores.

    The initial shuffle partition count is sized so each holds about
    ``target_partition_bytes`` of input (at least two waves of tasks); AQE
    then coalesces small partitions and splits skewed ones against the same
    target, so memory per task stays bounded whatever the scale.
    """
    parts = max(2 * cores, -(-int(input_bytes) // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.files.maxPartitionBytes": str(min(target_partition_bytes, 512 << 20)),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    Read from the session; only a local-mode session without the setting
    (tests) gets a private default. On a cluster the setting is required,
    because a machine-local folder is not visible to other executors.
    """
    global _LOCAL_DEFAULT_DIR
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    if _LOCAL_DEFAULT_DIR is None:
        _LOCAL_DEFAULT_DIR = tempfile.mkdtemp(prefix="tesserae-ckpt-")
    spark.sparkContext.setCheckpointDir(_LOCAL_DEFAULT_DIR)
    return _LOCAL_DEFAULT_DIR


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/tesserae/{name}-{uuid.uuid4().hex[:12]}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
