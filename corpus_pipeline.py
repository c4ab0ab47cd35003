"""The corpus pipeline: toxicity, exact copies, near copies, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Results for unusual input: a null text counts as empty; texts without words are kept by the near-copy
stage, equal texts, empty ones too, by the exact one in one row; rows that agree in id and text are one
document; very long texts are read whole at every stage; an empty table gives no pieces; columns beyond
those of documents go along to the packing, which reads the id and the text alone.
"""

import uuid

from tramline.llm import (
    digest_merge,
    fragment_join,
    ordered_packing,
    template_decontamination,
    toxicity_lexicon,
)
from tramline.llm.storage import cut, read_table, shared_folder


def toxicity(spark, docs, sf_dir):
    """Learns from the labelled documents of the table, drops the rows that score 0.5 or more."""
    rows = toxicity_lexicon.labelled(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), toxicity_lexicon.training_fold
    )
    return toxicity_lexicon.drop_toxic(docs, toxicity_lexicon.learn(cut(rows)))


def exact_dedup(spark, docs, sf_dir):
    """Of equal texts the row with the largest id stays."""
    return digest_merge.drop_exact_copies(docs, keep="largest")


def near_dedup(spark, docs, sf_dir):
    """Of documents connected by similarity the one with the smallest id stays."""
    return fragment_join.keep_one_per_component(docs)


def decontaminate(spark, docs, sf_dir):
    """Drops the documents that leak an item of the benchmark."""
    return template_decontamination.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark, docs, sf_dir):
    return ordered_packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]

# Learned scores, components and packing have no SQL form; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on documents; what stands between two stages is written to the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return docs
