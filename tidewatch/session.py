"""Session construction and the few session-level settings the library relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "tidewatch", **extra: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer; `extra` overrides."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    builder = SparkSession.builder.appName(app).config(map=conf)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, so that Arrow functions load wherever they run; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tidewatch-pkg-")  # read by the driver alone; Spark hands the file on
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder; where none is set, one is made for a local session (tests), and a cluster is an error."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidewatch-ckpt-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(f"file://{os.path.abspath(folder)}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a test-data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
