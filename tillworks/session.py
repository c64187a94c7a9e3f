"""Session helpers shared by jobs and tests."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def build_session(app: str = "tillworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on; cluster settings win where they are given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that they need no copy of their own."""
    context = spark.sparkContext
    if getattr(context, "_tillworks_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    # only the driver reads this file; Spark hands it on to the executors
    target = os.path.join(tempfile.mkdtemp(prefix="tillworks-"), "tillworks.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)
    context._tillworks_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or else one below the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_runs"


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run below the shared folder; `release_folder` removes it."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def release_folder(spark: SparkSession, folder: str) -> None:
    """Removes a run folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
