"""Session defaults, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that the operators rely on. Sizes that belong to a cluster (executors, shuffle partitions) are left to it.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int = 8, app: str = "sparkloom", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: what the session names; a temporary one where nothing is named and all runs on one machine (tests).

    A cluster must name a shared folder in ``spark.checkpoint.dir``: one on the driver's machine would be lost to executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    folder = named or tempfile.mkdtemp(prefix=f"sparkloom-{os.getpid()}-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, which all executors share, and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers: a zip of it goes out with the session, once."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_sparkloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    staged = Path(tempfile.mkdtemp(prefix="sparkloom-zip-"))
    atexit.register(shutil.rmtree, staged, ignore_errors=True)
    shutil.copytree(root, staged / "in" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(staged / f"{root.name}_package"), "zip", staged / "in"))
    sc._sparkloom_shipped = True
