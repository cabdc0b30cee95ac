"""Session set-up and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "iotrail", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own, and this package with --py-files."""
    root = str(Path(__file__).resolve().parent.parent)
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:  # Python workers import the package from here, whatever folder the session starts in
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("IOTRAIL_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="iotrail-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, which every executor can reach.

    Folders of one application share a parent, so that they can be dropped together.
    """
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def _base(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/iotrail-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has pinned. Call it when the results that build on them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_base(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from the written rows.

    Unlike an RDD checkpoint the table is columnar: later steps read only the
    columns they need.
    """
    folder = scratch(df.sparkSession, "pin")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
