"""SimHash near-dedup with BK-trees.

A fingerprint has a bit set where more than half of the document's shingle
hashes have it.  Equal fingerprints are grouped first.  Distinct fingerprints
within ``radius`` differing bits agree on at least one of ``radius + 1``
blocks of bits, so each (block, value) is a shard, and a shard's fingerprints
form a BK-tree: children are keyed by their integer Hamming distance to the
parent, and a search follows only edges within the radius of its distance.
A shard with more than ``SPLIT`` members is split again by the blocks of its
remaining bits, so that no task meets an unbounded group.

Trees are not broadcast: the fingerprints of all documents may not be gathered
on the driver, which a broadcast would need, and have no size bound.  Every
shard's tree is built where its members are, in one task, which searches it
for its own members and returns a spanning forest (at most one link a
member), never all pairs.
Components come from alternating large-star and small-star steps over the
distinct fingerprints that have links.

Defined cases: a null or empty text, or one without words, has fingerprint
zero, which is linked like any other; repeated rows have equal fingerprints;
an empty table gives an empty result.  A null doc_id takes part in linking,
but is no component's name unless all its members are null.  Other columns
are kept by ``keep_first`` and ignored by ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import near_copies
from quern.llm.common import as_bytes, checkpointed, components, joined_by_key, partitions, prepare, row_key, runs, slices, unused

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Distinct fingerprints of a shard from which it is split again.
SPLIT = 200
ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def shingle_hashes(text: bytes, k: int = SHINGLE) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    if k == 3:
        return [xxhash.xxh64_intdigest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:], strict=False)]
    return [xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(k)), strict=False)]


def fingerprints(texts: list[bytes], k: int = SHINGLE) -> np.ndarray:
    each = [shingle_hashes(t, k) for t in texts]
    n = np.array([len(h) for h in each], np.int64)
    return _majority(np.array([h for hs in each for h in hs], np.uint64), n)


def _majority(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each group of n consecutive hashes, the bits that over half have; zero for empty groups."""
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    starts = runs(n[some])[:-1]
    for bit in range(64):
        ones = np.add.reduceat((flat >> np.uint64(bit)) & np.uint64(1), starts)
        out[some] |= (2 * ones > n[some].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return out


def with_fingerprint(docs: DataFrame, column: str = "fp", k: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit number."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(as_bytes(part.column("text")), k).view(np.int64))], names=["doc_id", column])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField(column, T.LongType())]))


def distance(a, b) -> np.ndarray:
    x = np.atleast_1d(np.bitwise_xor(a, b))
    return ONES[x & np.uint64(0xFFFF)].astype(np.int64) + ONES[(x >> np.uint64(16)) & np.uint64(0xFFFF)] + ONES[(x >> np.uint64(32)) & np.uint64(0xFFFF)] + ONES[x >> np.uint64(48)]


class BKTree:
    """Distinct 64-bit values; a node's children are keyed by their distance to it."""

    def __init__(self, values: list[int]):
        self.values, self.children = [], []
        for v in values:
            self.add(v)

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while at != new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)

    def within(self, value: int, radius: int) -> list[int]:
        """Indexes of the values at most ``radius`` bits away."""
        out, open_ = [], [0] if self.values else []
        values, children = self.values, self.children
        while open_:
            at = open_.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                out.append(at)
            edges = children[at]
            if len(edges) <= 2 * radius + 1:
                open_ += [c for e, c in edges.items() if -radius <= e - d <= radius]
            else:
                open_ += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
        return out


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, smallest value of its part) for values that the tree links, without the smallest ones."""
    tree = BKTree(values)
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            if j < i:
                a, b = root(i), root(j)
                if a != b:
                    a, b = (a, b) if values[a] < values[b] else (b, a)
                    parent[b] = a
    return [(v, values[root(i)]) for i, v in enumerate(values) if root(i) != i]


def _blocks(parts: int, low: int = 0, high: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of ``parts`` blocks of the bits from low to high."""
    edges = [low + (high - low) * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _value(column, shift: int, width: int):
    return F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << width) - 1))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) with b < a: a spanning forest of the links between distinct fingerprints in column ``fp``."""
    spark = distinct.sparkSession
    blocks = _blocks(radius + 1)
    shards = F.array(*[F.struct(F.lit(k).alias("block"), _value(F.col("fp"), *b).alias("value")) for k, b in enumerate(blocks)])
    keyed = distinct.select("fp", F.explode(shards).alias("s")).select("fp", "s.block", "s.value")
    size = keyed.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = keyed.join(size, ["block", "value"])
    # a large shard's members agree on one block; of the other bits, again one block must agree
    finer = F.lit(None)
    for k, (shift, width) in enumerate(blocks):
        rest = [b for i, b in enumerate(_blocks(radius + 1)) if i != k]
        # the other blocks, halved or more, in radius + 1 parts
        parts = _parts(rest, radius + 1)
        ids = F.array(*[F.struct(F.lit(j).cast("int").alias("part"), _joined(F.col("fp"), p).alias("rest")) for j, p in enumerate(parts)])
        finer = F.when(F.col("block") == k, ids).otherwise(finer) if k else F.when(F.col("block") == k, ids)
    whole = F.array(F.struct(F.lit(-1).cast("int").alias("part"), F.lit(0).cast("long").alias("rest")))
    members = sized.select("fp", "block", "value", F.explode(F.when(F.col("n") > SPLIT, finer).otherwise(whole)).alias("p")).select("fp", "block", "value", "p.part", "p.rest")

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in rows.groupby(["block", "value", "part", "rest"], sort=False)["fp"]:
            if len(group) > 1:
                out += forest(group.to_numpy(np.int64).view(np.uint64).tolist(), radius)
        return pd.DataFrame(np.array(out, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    # several shards a group, so that small ones don't cost a call each
    many = partitions(spark)
    cell = F.pmod(F.xxhash64("block", "value", "part", "rest"), F.lit(many * 16)).cast("int")
    # the rows are few bytes but much work: dealt by number, or they would be merged into one task for their size
    return members.withColumn("cell", cell).repartition(many, "cell").groupBy("cell").applyInPandas(search, "a long, b long").distinct()


def _parts(blocks: list[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
    """The blocks' bits dealt into n parts of consecutive bits, each a list of (shift, width)."""
    bits = [s + i for s, w in blocks for i in range(w)]
    cut = [len(bits) * k // n for k in range(n + 1)]
    out = []
    for a, b in zip(cut, cut[1:], strict=False):
        spans: list[list[int]] = []
        for x in bits[a:b]:
            if spans and x == spans[-1][0] + spans[-1][1]:
                spans[-1][1] += 1
            else:
                spans.append([x, 1])
        out.append([(s, w) for s, w in spans])
    return out


def _joined(column, spans: list[tuple[int, int]]):
    out, at = F.lit(0).cast("long"), 0
    for shift, width in spans:
        out = out.bitwiseOR(F.shiftleft(_value(column, shift, width), at))
        at += width
    return out


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row; component_id is the smallest doc_id that links reach."""
    prepare(docs.sparkSession)
    own = checkpointed(with_fingerprint(docs, "fp", k))
    distinct = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(links(distinct.select("fp"), radius))
    named = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # only linked fingerprints need another look at their root
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(names, "root").select("fp", "component_id")
    return joined_by_key(own, of, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, similarity: float | None = None) -> DataFrame:
    """One row of each component: that with the smallest doc_id, nulls last; of equal ids, that with the smallest text hash.

    Without ``similarity``, components are those of ``near_duplicates``.  With
    it, texts whose five-word shingles have that Jaccard likeness are linked
    too; most of them differ in more bits than a BK-tree can search, and
    ``near_copies`` finds them.  Components are what both kinds of links
    reach.
    """
    key = unused("key", docs)
    rows = docs.withColumn(key, row_key())
    found = checkpointed(near_duplicates(rows.select(F.struct("doc_id", key).alias("doc_id"), "text")))
    if similarity is not None:
        return near_copies.keep_first(docs, similarity, joined=found.select(F.col(f"doc_id.{key}").alias("key"), F.col(f"component_id.{key}").alias("part")))
    order = lambda c: F.struct(F.col(f"{c}.doc_id").isNull().alias("none"), F.col(c).alias("row"))
    first = found.groupBy("component_id").agg(F.min(order("doc_id")).alias("first")).select(F.col(f"first.row.{key}").alias(key))
    return rows.join(first, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
