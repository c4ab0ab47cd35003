"""Session settings used by tests, the bench and the checks."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus="*", shuffle_partitions=8, app="tramline"):
    """A local session; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TRAMLINE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark):
    """The shared folder the cluster names; a private one only in local runs without any."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tramline-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_folder(spark):
    """A new folder for intermediate tables, inside the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
