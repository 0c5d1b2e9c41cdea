"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Session settings every job relies on. AQE re-plans joins at runtime
# (broadcast when a side turns out small, split skewed partitions), and the
# session zone is pinned so date formatting never depends on the host.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "provenant", extra: dict | None = None) -> SparkSession:
    """A session with these defaults. A submitted master stands; without one the
    job is a local run. Partitions are set only where the caller names them."""
    builder = SparkSession.builder.appName(app_name)
    conf = dict(DEFAULT_CONF)
    submitted = os.environ.get("MASTER") or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    if master or not submitted:
        cpus = os.environ.get("BENCH_CPUS", "8")
        builder = builder.master(master or f"local[{cpus}]")
        conf["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", "16g")
        shuffle_partitions = shuffle_partitions or (None if master else int(cpus))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and landed files.

    On a cluster the operator names it in ``spark.checkpoint.dir``; we read it
    from the session. Only when it is unset (local tests) do we create one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="provenant-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for landed outputs."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package (once per context): the driver's own path
    doesn't reach them, so the sources travel as a zip through Spark's file server."""
    sc = spark.sparkContext
    if getattr(sc, "_provenant_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="provenant-py-"), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(target)
    sc._provenant_shipped = True
