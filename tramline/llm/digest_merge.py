"""Exact duplicates by a tree merge of digest runs.

Every partition of the input yields a run: one row per text digest with its best identifier and
its count. Runs are merged in binomial rounds: in each round the runs whose numbers agree after
division by the fan-in are merged, digest by digest, into one run that keeps the best identifier
and the sum of the counts. Spark's partial aggregation reduces a run before it is sent, and the
digest is part of the shuffle key, so neither one frequent text nor one merged run meets in a
single task before it has shrunk to a row per run.

The answer goes back along the first level: a row looks up its own group of runs there, so the
copies of one text stay spread over as many keys as there are groups of runs.

An identifier is verified at every level: texts meet only if their SHA-256, their length in bytes
and a second, independent hash all agree.

Results for unusual input: a null text is empty; a null identifier loses against any other; rows
that agree in identifier and text are ties of which exactly one is marked as kept; an empty table
gives an empty result.
"""

from pyspark.sql import functions as F

from .storage import cut, keep_rows, text_of

FAN_IN = 8
MATCH = ["sha", "n_bytes", "second"]


def digest_rows(docs, id_column="doc_id", text_column="text"):
    """Identifier, digests, number of the run (partition) and number of the row."""
    text = text_of(text_column)
    return docs.select(
        F.col(id_column).alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("second"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )


def _better(keep):
    """Rank of a row, and the aggregate that takes the better of two."""
    if keep == "largest":
        return F.struct(F.col("doc_id").isNotNull().alias("a"), F.col("doc_id"), (-F.col("row")).alias("row")), F.max
    if keep == "smallest":
        return F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id"), F.col("row")), F.min
    raise ValueError(f"unknown rule {keep}")


def merge_rounds(runs, n_runs, best, fan_in=FAN_IN):
    """Levels of merged runs, the first one with at most n_runs / fan_in runs, the last with one."""
    levels = []
    while True:
        n_runs = -(-n_runs // fan_in)
        runs = (
            runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy("run", *MATCH)
            .agg(best("best").alias("best"), F.sum("size").alias("size"))
        )
        if not levels:
            runs = cut(runs)
        levels.append(runs)
        if n_runs <= 1:
            return levels


def exact_groups(docs, keep="smallest", id_column="doc_id", text_column="text", fan_in=FAN_IN):
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(digest_rows(docs, id_column, text_column))
    rank, best = _better(keep)
    leaves = rows.select("run", *MATCH, rank.alias("best"), F.lit(1).cast("long").alias("size"))
    levels = merge_rounds(leaves, max(1, rows.rdd.getNumPartitions()), best, fan_in)
    root = levels[-1].select(*MATCH, F.col("best").alias("winner"), F.col("size").alias("group_size"))
    first = levels[0].select("run", *MATCH).join(root, MATCH)
    return (
        rows.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        .join(first, ["run", *MATCH])
        .select(
            "doc_id",
            F.col("winner.doc_id").alias("keep_id"),
            "group_size",
            (F.abs("winner.row") == F.col("row")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def drop_exact_copies(docs, keep="smallest", id_column="doc_id", text_column="text"):
    """The rows of ``docs`` that stay, with all their columns."""
    groups = exact_groups(docs, keep, id_column, text_column).filter("kept")
    keys = groups.select(
        F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_sha256").alias("_key")
    )
    return keep_rows(docs, keys, id_column, text_column)
