"""The near-copy join against all pairs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import near_copies, simhash

DOCS = "doc_id long, text string"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def plain_parts(texts, similarity=0.8, k=5):
    """The number of each text's part, by all pairs."""
    sets = []
    for t in texts:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    part = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if part[a] != part[b] and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])):
            old, new = max(part[a], part[b]), min(part[a], part[b])
            part = [new if p == old else p for p in part]
    return part


def corpus(seed):
    """Families of copies from close to too far, a large family, a passage in many texts, short, equal and empty texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bcdfgklmnaeiou") for _ in range(5))
    passage = [word() for _ in range(50)]
    texts = []
    for g in range(15):
        base = [word() for _ in range(r.randint(20, 150))]
        for c in range(60 if g == 0 else r.randint(1, 7)):
            w = list(base)
            for _ in range(r.randint(0, 1 + len(w) // 35) if c else 0):
                w[r.randrange(len(w))] = word()
            if c and r.random() < 0.3:
                w = w[r.randint(0, len(w) // 8) :]
            texts.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
    for _ in range(25):
        texts.append(" ".join([word() for _ in range(r.randint(0, 40))] + passage + [word() for _ in range(r.randint(0, 40))]))
    texts += [None, "", " \n", "a b", "A  b", "a c", "x y z w", " ".join(word() for _ in range(5000)), texts[3], texts[3]]
    return texts


@pytest.mark.parametrize(("group", "salted", "most", "parts"), [(1 << 20, 4096, 1 << 20, 3), (3000, 8, 1 << 20, 1), (1000, 3, 40, 5)])
def test_all_pairs(spark, monkeypatch, group, salted, most, parts):
    """Groups whole and in blocks, with and without salts and the list of common shingles: always the parts of all pairs."""
    monkeypatch.setattr(near_copies, "GROUP", group)
    monkeypatch.setattr(near_copies, "SALTED", salted)
    texts = corpus(group)
    want = plain_parts(texts)
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(parts, "doc_id")
    assert dict(rows(near_copies.near_copies(df, most=most), "doc_id", "component_id")) == dict(enumerate(want))
    assert len(set(want)) < len(want) - 50


def test_chains_across_blocks(spark, monkeypatch):
    """A part that hangs together by a chain, none of whose far ends is alike to the group's first member."""
    monkeypatch.setattr(near_copies, "GROUP", 300)
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words[8 * i : 8 * i + 100]) for i in range(25)]
    random.Random(3).shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    assert dict(rows(near_copies.near_copies(df), "doc_id", "component_id")) == dict(enumerate(plain_parts(texts)))


def test_one_of_each_group_stays(spark):
    texts = corpus(5)
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    assert sorted(r["doc_id"] for r in near_copies.keep_first(df).collect()) == sorted(set(plain_parts(texts)))


def test_rows_of_one_id(spark):
    """Rows of one id with different texts are rows of their own; equal rows are one; null ids come last."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    data = [(1, a, 0), (1, b, 1), (1, b, 2), (2, a + " c", 3), (None, b, 4), (None, "n n", 5), (None, "n n", 6), (7, None, 7), (8, "", 8)]
    df = spark.createDataFrame(data, "doc_id long, text string, key int").withColumn("_key", F.lit("x"))
    want = [(1, a), (1, b), (None, "n n"), (7, None)]
    # three-word fingerprints of 2 (and 1) are further apart than two bits
    for out, more in ((simhash.keep_first(df, 0.8), []), (simhash.keep_first(df), [(2, a + " c")])):
        assert out.columns == df.columns
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert sorted(got, key=str) == sorted(want + more, key=str)


def test_text_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("y", "a b c d e f"), ("x", "A b c d e f"), ("z", "other")], "doc_id string, text string")
    assert rows(near_copies.near_copies(df), "doc_id", "component_id") == [("x", "x"), ("y", "x"), ("z", "z")]
    assert near_copies.near_copies(df.where("false")).count() == 0 and near_copies.keep_first(df.where("false")).columns == df.columns


def test_tested():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 30, 25).astype(np.uint64)) for _ in range(60)]
    part = np.arange(60)
    for i, j in near_copies.tested(np.arange(60), sets, 0.6):
        both = len(np.intersect1d(sets[i], sets[j]))
        assert both / (len(sets[i]) + len(sets[j]) - both) >= 0.6
        assert part[i] != part[j]
        part[part == part[j]] = part[i]
    for i, j in itertools.combinations(range(60), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        assert part[i] == part[j] or both / (len(sets[i]) + len(sets[j]) - both) < 0.6


def test_bitmaps_keep_alike_sets_together():
    """Alike sets of any sizes and widths hang together; unlike ones, and sets of other leads, do not."""
    r = np.random.default_rng(2)
    sets, lead = [], []
    for g in range(40):
        base = np.unique(r.integers(0, 1 << 63, int(r.integers(1, 700))).astype(np.uint64))
        for _ in range(4):
            other = r.integers(0, 1 << 63, int(r.integers(0, 1 + len(base) // 7))).astype(np.uint64)
            sets.append(np.unique(np.concatenate([base[len(other) // 2 :], other])))
            lead.append(g % 3)
    part = near_copies.maybe_alike(np.array(lead), np.array([len(s) for s in sets]), [near_copies.parity(s) for s in sets], 0.8)
    alike = 0
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if lead[i] != lead[j]:
            assert part[i] != part[j]
        elif both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            assert part[i] == part[j]
            alike += 1
        elif not both and min(len(sets[i]), len(sets[j])) > 60:
            assert part[i] != part[j]
    assert alike > 50


def test_unlike_texts_are_not_sent(spark):
    """Of texts that share a passage, without a list of common shingles, only near copies are tested, and in one group."""
    words = [f"p{i}" for i in range(60)]
    texts = [" ".join([f"a{t}x{i}" for i in range(40)] + words + [f"b{t}x{i}" for i in range(40)]) for t in range(30)]
    texts += [texts[7] + " more", texts[7] + " still more"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = near_copies.members_of_groups(df, most=0).collect()
    nodes = {near_copies._node(near_copies.name_of(near_copies.shingle_sets([texts[i].encode()])[0])) for i in (7, 30, 31)}
    assert sorted((m["lead"], m["node"]) for m in got) == sorted((min(nodes), n) for n in nodes)
    assert [c for i, c in rows(near_copies.near_copies(df, most=0), "doc_id", "component_id") if i in (7, 30, 31)] == [7, 7, 7]


def test_groups_too_large_for_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "FILTERED", 2000)
    monkeypatch.setattr(near_copies, "GROUP", 500)
    texts = corpus(9)
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    assert dict(rows(near_copies.near_copies(df, most=40), "doc_id", "component_id")) == dict(enumerate(plain_parts(texts)))


def test_fingerprints_link_too(spark):
    """With a likeness, what fingerprints within two bits link goes as well, and links of both kinds make one group."""
    r = random.Random(8)
    word = lambda n: [f"{r.choice('bcdfg')}{r.randrange(10**6)}" for _ in range(n)]
    often = "again and again " * 2000
    far = [f"{often}{' '.join(word(60))}" for _ in range(3)]  # repeats decide the fingerprint, the likeness is small
    tail = far[1].split()
    chain = " ".join(tail[:-1])  # alike to far[1]
    other = [" ".join(word(80)) for _ in range(4)]
    texts = [*other, *far, chain]
    prints = simhash.fingerprints([t.encode() for t in texts]).tolist()
    near = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2}
    jaccard = plain_parts(texts)
    assert {(4, 5), (4, 6), (5, 6)} <= near and jaccard == [0, 1, 2, 3, 4, 5, 6, 5]
    want = list(jaccard)
    for _ in texts:
        for i, j in near:
            want = [min(want[i], want[j]) if p in (want[i], want[j]) else p for p in want]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    assert sorted(r["doc_id"] for r in simhash.keep_first(df, 0.8).collect()) == sorted(set(want)) == [0, 1, 2, 3, 4]
    assert sorted(r["doc_id"] for r in near_copies.keep_first(df).collect()) == [0, 1, 2, 3, 4, 5, 6]
