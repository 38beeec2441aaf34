"""Session factory and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "sparkloom", cores: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine assumes; `conf` wins over them."""
    n = cores or os.cpu_count() or 1
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(max(8, n)),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": "8g",
    } | conf
    spark = SparkSession.builder.master(f"local[{n}]").appName(app).config(map=settings).getOrCreate()
    share_path(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: the cluster's spark.checkpoint.dir, or in local mode a folder of our own."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at:
        return at
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="sparkloom-checkpoint-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the shared checkpoint folder, so a lost executor loses nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def share_path(spark: SparkSession) -> None:
    """Lets Python workers on machines that have this folder find the package; elsewhere it comes by --py-files."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
