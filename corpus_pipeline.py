"""The corpus pipeline: each stage on all that the one before it kept."""

import uuid

from pyspark.sql import functions as F

from curbside.llm.bpe import ids_of
from curbside.llm.common import small_batches, table
from curbside.llm.decontaminate import without_benchmarks
from curbside.llm.quality import keep_quality
from curbside.llm.secret_spans import without_secrets
from curbside.llm.simhash import keep_one_of_group
from curbside.session import shared_dir


def quality(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each SimHash group stays."""
    return keep_one_of_group(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return without_benchmarks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark, docs, sf_dir):
    """Every document stays, its secrets marked out."""
    return without_secrets(docs)


def tokens(spark, docs, sf_dir):
    """doc_id, n_tokens and the token ids of each document."""
    small_batches(spark)
    coded = docs.select("doc_id", ids_of()("text").alias("ids"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("bpe", tokens),
]

#: The stages have no SQL; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        out = f"{place}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
