"""Session helpers of the library."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Give this package's modules to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="papyrion-"), "papyrion.zip")
        with zipfile.ZipFile(target, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent).as_posix())
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    return spark


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("papyrion")
    settings = {
        "spark.sql.shuffle.partitions": str(cores) if str(cores).isdigit() else "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    named = {"spark_sql_shuffle_partitions": "spark.sql.shuffle.partitions", "spark_checkpoint_dir": "spark.checkpoint.dir", "spark_sql_warehouse_dir": "spark.sql.warehouse.dir", "spark_driver_memory": "spark.driver.memory"}
    for key, value in {**settings, **{named.get(k, k.replace("_", ".")): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Where none is configured, a session that runs in one process on this machine gets a temporary one; a cluster has to name its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return configured or current
    if not configured and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    target = configured or tempfile.mkdtemp(prefix="papyrion-checkpoints-")
    sc.setCheckpointDir(target)
    return target


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows go to the shared checkpoint folder once and are read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
