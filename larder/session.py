"""Spark session settings shared by tests, the benchmark and examples.

On a cluster the session is created by the platform; ``configure`` only fills
in settings that are unset, so cluster-provided values (shuffle partitions,
checkpoint directory, broadcast thresholds) always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators are designed around.  AQE re-plans joins from runtime
# sizes (a dimension side is broadcast only when its measured size is under the
# threshold, otherwise the sort-merge join stays), coalesces small shuffle
# partitions and splits skewed join partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of DataFrames that are gone are removed by the cleaner
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.checkpoint.compress": "true",
    # scans by row rank cut parts at sampled bounds: more samples, more even parts
    "spark.sql.execution.rangeExchange.sampleSizePerPartition": "400",
    # streaming state (one balance per product) on local disk, not the JVM heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(
    master: str = "local[8]",
    shuffle_partitions: int = 8,
    app_name: str = "larder",
    extra: dict | None = None,
) -> SparkSession:
    """Local session for tests and the benchmark."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "8g"
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``.  Only when the setting is absent (local
    tests) a fresh scratch folder is created and registered.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="larder-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server applies spark.checkpoint.dir itself
        return current
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def configure_for_scale(spark: SparkSession, input_bytes: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Size shuffles for a large input on a cluster: an initial shuffle
    partition count of input / target (AQE coalesces small ones and splits
    skewed ones at runtime), and the advisory partition size.  Settings the
    cluster already made are kept.  Returns what was set."""
    wanted = {
        "spark.sql.shuffle.partitions": str(max(200, input_bytes // target_partition_bytes)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(min(target_partition_bytes, 512 << 20)),
    }
    preset = _cluster_set(spark)
    applied = {}
    for key, value in wanted.items():
        if key not in preset:
            spark.conf.set(key, value)
            applied[key] = value
    return applied


def _cluster_set(spark: SparkSession) -> set:
    """Keys set explicitly in the SparkContext configuration (cluster defaults)."""
    return {k for k, _ in spark.sparkContext.getConf().getAll()}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``larder`` importable in the Python workers (pandas UDFs and
    stateful functions import it): zip the package once per application into a
    folder of the driver and ``addPyFile`` it, which Spark serves to the
    executors.  Harmless when the package is installed on the cluster already."""
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: install the package on the cluster instead
        return
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="larder-code-"), "larder.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)
