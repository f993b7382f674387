"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Options every retailcast job relies on: UTC dates, AQE re-planning
# (partition coalescing and skew-join splitting) and Arrow transfer for the
# few pandas UDFs.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "retailcast", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the options above.

    The master, the driver's memory and the number of shuffle partitions are left to
    ``spark-submit`` and the cluster's configuration unless they are given here.
    """
    builder = SparkSession.builder.appName(app)
    conf = dict(DEFAULT_CONF)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``retailcast`` importable on the executors' Python workers.

    Pandas functions (mapInPandas / cogroup applyInPandas) reference module
    code, so the package is zipped once on the driver and distributed with
    ``addPyFile`` -- the same as ``--py-files`` on spark-submit.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="retailcast-pyfiles-"), "retailcast.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


# Bounds of the initial number of shuffle partitions: a shuffle has map tasks x partitions
# blocks, so far more partitions than these cost more than they spread.
MAX_SHUFFLE_PARTITIONS = 20_000


def scale_conf(shuffle_bytes: int, executor_cores: int, partition_bytes: int = 128 << 20,
               scan_split_bytes: int = 256 << 20) -> dict[str, str]:
    """Session options for a large run.

    ``shuffle_bytes`` is what the largest shuffle writes (for the forecasting jobs the daily
    panel, a small part of the input), not the input. Partitions: enough for ``partition_bytes``
    each, two waves of the cores at least, at most MAX_SHUFFLE_PARTITIONS, in whole waves;
    AQE coalesces small ones and splits skewed ones.
    """
    cores = max(1, executor_cores)
    wanted = max(-(-int(shuffle_bytes) // partition_bytes), 2 * cores)
    parts = max(cores, min(-(-wanted // cores) * cores, MAX_SHUFFLE_PARTITIONS // cores * cores))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(scan_split_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a private scratch folder is used, but only for a master whose driver and
    executors are one process (``local``, ``local[n]``); any other master raises, as each
    executor would write to a disk of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder for master {sc.master}")
        configured = tempfile.mkdtemp(prefix="retailcast-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
