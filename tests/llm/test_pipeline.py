"""The pipeline's stages on a small corpus."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = tmp_path_factory.mktemp("corpus")
    base = [f"w{i} x{i * 7} plain{i % 5} text number{i * 3} goes on with several more words{i} here and there{i * 11}" for i in range(40)]
    rows = [(i, f"{t}\nShared FOOTER line", "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(100, "you stupid moron idiot scum", "en", "s", 1), (101, rows[3][1], "en", "s", 1), (102, None, None, None, None)]
    leak = "one two three four five six seven eight nine ten eleven"
    rows.append((103, f"before {leak} after", "en", "s", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(1, leak.upper())], "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    return str(to)


def test_pipeline(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == {*range(40), 102}
    assert got[102]["token_ids"] == [] and all(r["n_tokens"] == len(r["token_ids"]) for r in got.values())
    text = dict((r["doc_id"], r["text"]) for r in bpe.decode(out.where("doc_id = 7")).collect())[7]
    assert "footer" not in text and "plain 2" in text


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.withColumn("score", F.lit("x")), folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_empty(spark, folder, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
