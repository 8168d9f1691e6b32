"""The pipeline's stages against the plain meaning of each, on whole tables and on odd ones."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from llm_fixtures import empty_dir, odd_dir, odd_docs, odd_rows  # noqa: F401
from spacetide.llm import byte_bpe, decontaminate, quality, simhash


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_on_odd_documents(spark, odd_dir, odd_docs):
    for name, f in corpus_pipeline.STAGES[:-1]:
        found = f(spark, odd_docs, odd_dir)
        assert found.columns == odd_docs.columns
        assert found.count() <= odd_docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, odd_docs, odd_dir).filter("round_trip").count() == odd_docs.count()


def test_empty_tables(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Each stage's input and result, one stage after the other on the driver's smallest tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, docs, sf_dir).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_every_stage_ran(stages):
    """Its time is that of the five stages, one after the other."""
    assert list(stages) == [name for name, _ in corpus_pipeline.STAGES]


def test_quality_stage_by_its_operator(spark, sf_dir, stages):
    before, after = stages["quality rules"]
    judged = quality.judged(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "kept").collect()  # a filter would be evaluated inside every expression
    assert ids(after) == sorted(r.doc_id for r in judged if r.kept) and after.columns == before.columns


def test_near_duplicate_stage_by_its_operator(stages):
    before, after = stages["simhash near-duplicates"]
    groups = simhash.near_duplicates(before)
    assert ids(after) == sorted(r.component_id for r in groups.select("component_id").distinct().collect())


def test_decontamination_stage_by_its_operator(spark, sf_dir, stages):
    before, after = stages["benchmark decontamination"]
    bad = decontaminate.contamination(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated")
    assert ids(after) == sorted(set(ids(before)) - set(ids(bad)))


def test_secrets_are_gone(stages):
    before, after = stages["secret scans"]
    assert ids(after) == ids(before) and after.filter(F.length("text") != F.col("n_chars")).count() == 0
    assert after.filter(F.col("text").rlike("[0-9a-f]{24}")).count() == 0
    assert before.join(after, ["doc_id", "text"]).count() + after.filter(F.col("text").rlike(r"\[(assign|access|hex|random)\]")).count() == before.count()


def test_ids_of_the_last_stage(spark, stages):
    before, after = stages["byte-level bpe"]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    texts = {r.doc_id: r.text for r in before.collect()}
    found = after.collect()
    assert len(found) == len(texts) and all(r.round_trip for r in found)
    for r in found:
        assert np.frombuffer(r.ids, "<u4").tolist() == encoder.encode_ordinary(texts[r.doc_id])
        assert len(r.offsets) == len(r.ids) + 4


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    found = corpus_pipeline.run(spark, sf_dir)
    last = stages["byte-level bpe"][1]
    assert sorted(map(tuple, found.select("doc_id", "n_tokens").collect())) == sorted(map(tuple, last.select("doc_id", "n_tokens").collect()))
