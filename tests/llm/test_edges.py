"""Awkward tables for every operator: columns with inner names, null, repeated and text ids, empty and very long texts, no rows."""

import pytest
from pyspark.sql import functions as F
from test_operators import rows

from quern.llm import bpe, chat, decontaminate, html_text, line_dedup, quality, simhash, spotsigs, substring_dedup, toxicity

#: Names that the operators use inside.
INNER = "key _key mark hits starts spans shingles salt token name part lead node bit shard cell block chunk root fp refs first row doc nxt signs __id __mark __starts __m __hits __key __host __guest __spans __items count".split()
LONG = "long " * 30_000
DATA = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (2, None), (3, ""), (4, " \n\t"), (5, LONG), (6, "one two three four five six seven eight nine ten eleven"), (7, "x\ny\nx")]
KEEPING = {
    "lines": lambda d, s: line_dedup.dedup_lines(d, min_docs=3),
    "lines_joined": lambda d, s: line_dedup.dedup_lines(d, min_docs=3, broadcast_limit=0),
    "passages": lambda d, s: substring_dedup.dedup_substrings(d),
    "benchmark": lambda d, s: decontaminate.decontaminate(d, s.createDataFrame([("i", "three four five six seven eight nine ten eleven twelve"[:43]), (None, "x y")], "item_id string, text string")),
    "toxicity": lambda d, s: toxicity.score(d, toxicity.SEED),
    "quality": lambda d, s: quality.score(d, quality.prior()),
    "fingerprints_first": lambda d, s: simhash.keep_first(d),
    "copies_first": lambda d, s: simhash.keep_first(d, 0.8),
}
FIXED = {
    "signatures": (lambda d: spotsigs.fingerprints(d), 7),
    "simhash": (lambda d: simhash.near_duplicates(d), 3),
    "toxicity": (lambda d: toxicity.scored(d, _labels(d)), 4),
    "quality": (lambda d: quality.scored(d, _labels(d)), 4),
    "lines": (lambda d: line_dedup.dedup_lines(d, digests=True), 4),
    "passages": (lambda d: substring_dedup.dedup_substrings(d, digests=True), 4),
    "bpe": (lambda d: bpe.encode(d, digests=True), 4),
    "bpe_ids": (lambda d: bpe.encode(d).withColumn("token_ids", F.col("token_ids").cast("string")), 3),
}


def _labels(d):
    return d.sparkSession.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")


def table(spark, kind="long"):
    df = spark.createDataFrame([(None if i is None else str(i), t) for i, t in DATA], "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    return df.withColumns({n: F.lit(f"own {n}") for n in INNER})


@pytest.mark.parametrize("name", KEEPING)
def test_columns_are_kept(spark, name):
    df = table(spark)
    out = KEEPING[name](df, spark)
    kept = [c for c in df.columns if c != "text" or "text" in out.columns]
    assert [c for c in out.columns if c in df.columns] == kept
    got = out.collect()
    assert all(r[n] == f"own {n}" for r in got for n in INNER)
    assert len(got) == len(DATA) if not name.endswith("first") else 0 < len(got) < len(DATA)
    assert KEEPING[name](df.where("false"), spark).count() == 0


@pytest.mark.parametrize("name", KEEPING)
def test_ids_of_text(spark, name):
    assert KEEPING[name](table(spark, "string"), spark).schema["doc_id"].dataType.simpleString() == "string"


@pytest.mark.parametrize("name", FIXED)
def test_results(spark, name):
    run, width = FIXED[name]
    out = run(table(spark))
    assert len(out.columns) == width and out.count() == len(DATA)
    by_row = {}
    for r in out.collect():
        # of two rows with one id, one comes next after the other, so what it is compared to differs
        by_row.setdefault(r["doc_id"], set()).add(r["fingerprint"] if name == "signatures" else tuple(r))
    assert len(by_row[1]) == 1  # repeated rows are judged alike
    assert run(table(spark).where("false")).count() == 0


def test_pages_and_chats(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (None, None, None)], "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit(2)})
    assert html_text.extract(pages).count() == 3 and html_text.extract(pages.where("false")).count() == 0
    turns = spark.createDataFrame([(None, 0, "u", "a"), (None, 1, None, None), (1, None, "u", "b"), (1, None, "u", "b")], "conv_id long, turn long, role string, text string").withColumns({"n": F.lit(0), "last": F.lit("x"), "a": F.lit(1), "kept": F.lit(2)})
    assert rows(chat.formatted(turns), "conv_id", "n_turns") == [(1, 1), (None, 2)]
