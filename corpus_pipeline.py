"""A training-corpus pipeline over ``documents``: five stages, each on all that the one before kept.

1. toxicity: documents scored 0.5 or more go.
2. line dedup: lines found in ten documents or more go from every document.
3. SimHash near-dedup: of each group of near copies the smallest doc_id stays.
   Texts are linked if their fingerprints differ in two bits or fewer, as
   BK-trees find them, or if their five-word shingles have a Jaccard likeness
   of 0.8 or more, which most such fingerprints cannot show.
4. decontamination: documents that hold a benchmark window go.
5. BPE: the rest as token ids.

All stages but the last return the columns of ``documents``; rows with null
or empty texts pass like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontaminate, line_dedup, near_copies, simhash, toxicity
from quern.llm.common import read, remove_folder, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), lexicon, "score").where("score < 0.5").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(line_dedup.dedup_lines(docs.select(*COLUMNS)))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs.select(*COLUMNS), near_copies.SIMILARITY)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: The learned stage and the token ids are beyond SQL; ``tests/llm/test_pipeline.py`` has a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again.

    A table that the next one was made from is removed as soon as that one is
    written; the last one stays, as the result reads it.
    """
    base = shared_folder(spark, "pipeline")
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
