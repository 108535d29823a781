"""The registered corpus queries on the smallest tables, and the pipeline."""

import os

import numpy as np
import public_tokenizers
import pytest
from harness import compare, duck
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from curbside.llm import decontaminate, queries, quality, secret_spans, simhash

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(queries.REGISTRY))
def test_query(spark, con, name):
    assert name in entry.queries()
    assert compare(spark, con, name, queries.REGISTRY[name], queries.ORACLE.get(name), FOLDER) is None


def test_pipeline_like_plain_steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    kept = sorted(good)
    prints = np.array([simhash.fingerprint_of(texts[i].encode()) for i in kept]).view(np.uint64)
    least = list(range(len(kept)))
    for _ in range(len(kept)):
        before = list(least)
        for k in range(len(kept)):
            least[k] = min(least[j] for j in np.flatnonzero(np.bitwise_count(prints ^ prints[k]) <= 4))
        if before == least:
            break
    unique = [i for k, i in enumerate(kept) if least[k] == k]
    leaked = {r["doc_id"] for r in decontaminate.contaminated(docs, items).collect()}
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {
        i: coder.encode(secret_spans.redact(texts[i]), add_special_tokens=False).ids for i in unique if i not in leaked
    }
    assert 0 < len(expected) < len(unique) < len(kept) < len(texts)
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"]: r["ids"] for r in out} == expected and len(out) == len(expected)
    assert all(r["n_tokens"] == len(r["ids"]) for r in out)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("*", "1 as ids", "'x' as row")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).schema.names == docs.columns
        assert stage(spark, docs.where("false"), FOLDER).count() == 0
