"""Lineage cuts, table reads and row keys shared by the operators."""

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F


def cut(frame):
    """Write a frame to the folder named by spark.checkpoint.dir and go on from the files.

    What follows survives lost executors without recomputing what came before; Spark removes
    the files with the frame where cleaning of checkpoints is on. Only local sessions that name
    no folder get one of their own.
    """
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def shared_folder(spark):
    """The folder for intermediate data; without it, a local session's own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tramline-"))
    return folder or context.getCheckpointDir()


def stored(frame):
    """The same cut for frames with much data: compressed Parquet in the shared folder."""
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def read_table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column="text"):
    """The text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(id_column="doc_id", text_column="text"):
    """A non-null key of a row: its id and the SHA-256 of its text."""
    return F.concat_ws(
        ":", F.coalesce(F.col(id_column).cast("string"), F.lit("-")), F.sha2(text_of(text_column), 256)
    )


def keep_rows(docs, kept_keys, id_column="doc_id", text_column="text"):
    """The rows of ``docs`` whose key is in ``kept_keys`` (one column ``_key``), each key once.

    Rows that agree in id and text are one document: the first in the order of a hash over all
    columns stays. The limit to one row works before the shuffle, so a row repeated any number of
    times costs one row per task; the text is shuffled once for both steps.
    """
    names = docs.columns
    order = Window.partitionBy("_key").orderBy("_order")
    single = (
        docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"),
                    row_key(id_column, text_column).alias("_key"),
                    F.xxhash64(*[F.col(f"`{n}`") for n in names]).alias("_order"))
        .withColumn("_place", F.row_number().over(order))
        .filter("_place = 1")
    )
    return single.join(kept_keys.select("_key"), "_key", "left_semi").select("_row.*")
