"""Session helpers.

Cluster settings win: anything already configured on the session (for
example ``spark.checkpoint.dir`` naming a shared folder) is read, never
overwritten. Local defaults are only filled in where a key is unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tipscope") -> SparkSession:
    """Return the active session, or build a local one for tests/bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions",
                             str(shuffle_partitions or int(cpus)))
    builder = builder.config("spark.driver.memory", "16g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and materialised intermediates.

    Uses ``spark.checkpoint.dir`` when the cluster names one. Where it is unset
    a local master (tests) gets a fresh scratch folder; any other is refused,
    as executors don't share the driver's disk.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a local context
        sc = None
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d and sc is not None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="tipscope-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d) if sc is None else sc.setCheckpointDir(d)
    elif sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def app_id(spark: SparkSession) -> str:
    """Identifier of the running application (keys per-application caches)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001
        return spark.conf.get("spark.app.id", "app")
