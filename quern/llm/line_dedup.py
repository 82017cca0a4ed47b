"""Line dedup: sharded cuckoo filters over exact reference-count tables.

The index has two parts.  ``counts`` is exact: one row per line key with the
number of documents that hold it.  ``filters`` has one cuckoo filter per
shard with the keys that reach the threshold.  Inserting documents adds to
the counts, deleting them subtracts, and only keys that cross the threshold
enter or leave a filter, so an insertion followed by the deletion of the
same documents restores the state.

Dropping lines needs one pass over the texts: the filters (two bytes a key,
size-checked before they are broadcast) find candidate lines, and the few
rarer keys of the exact table that a filter also accepts are broadcast as
exceptions, so the decision on every indexed line is exact.  Beyond the
bound, lines are joined to the exact table instead, with the same result.

Defined cases: a null or empty text is one empty line; keys shorter than
``min_length`` code points are never dropped; rows of one doc_id that are
inserted together count as one document, and so do all rows without one, but
every row keeps a result of its own; an empty table gives an empty result.
Output columns take the place of input columns of the same name; all others
are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import BROADCAST_BYTES, SPACES, as_bytes, checkpointed, partitions, prepare, slices, table, unused

KEY_BYTES = 16
SLOTS = 4
MAX_KICKS = 500
SALTS = 16
COUNTS = "key binary, refs long"
FILTERS = "shard int, buckets int, items long, slots binary"


def line_key(line: bytes) -> bytes:
    """The line without outer white space, A-Z in lower case."""
    return line.strip(SPACES).lower()


def code_points(key: bytes) -> int:
    return len(key) - sum(0x80 <= b < 0xC0 for b in key) if not key.isascii() else len(key)


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=KEY_BYTES).digest()


class CuckooFilter:
    """Partial-key cuckoo hashing: 16-bit fingerprints, four slots a bucket, two buckets a key.

    Keys are digests, so their bytes serve as hash values.  It answers True for
    each key inserted and not deleted, and for about one in 8,000 others.
    """

    def __init__(self, buckets: int, slots: np.ndarray | None = None, items: int = 0):
        self.buckets, self.items = buckets, items
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * 0.85 < max(n, 1):
            buckets *= 2
        return cls(buckets)

    @classmethod
    def built(cls, keys: list[bytes]) -> CuckooFilter:
        out = cls.sized(len(keys))
        while not all(out.insert(k) for k in keys):
            out = cls(out.buckets * 2)
        return out

    def _where(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """digests: (n, 2) uint64."""
        mark = (digests[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (digests[:, 0] & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, first, first ^ self._jump(mark)

    def _jump(self, mark: np.ndarray) -> np.ndarray:
        return ((mark.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995) >> np.uint64(20)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, digests: np.ndarray) -> np.ndarray:
        if not len(digests):
            return np.zeros(0, bool)
        mark, a, b = self._where(digests)
        return (self.slots[a] == mark[:, None]).any(1) | (self.slots[b] == mark[:, None]).any(1)

    def insert(self, key: bytes) -> bool:
        """False if no place was found; the filter must then be rebuilt larger."""
        mark, a, b = (x[0] for x in self._where(split(key)))
        rng = int.from_bytes(key[:4], "little")
        for at in (a, b):
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = mark
                self.items += 1
                return True
        at = b
        for _ in range(MAX_KICKS):
            rng = (rng * 1103515245 + 12345) & 0x7FFFFFFF
            k = (rng >> 8) % SLOTS
            mark, self.slots[at, k] = self.slots[at, k].copy(), mark
            at = at ^ self._jump(np.array([mark], np.uint16))[0]
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = mark
                self.items += 1
                return True
        return False

    def delete(self, key: bytes) -> bool:
        """Removes one copy of the key's fingerprint; only for keys that were inserted."""
        mark, a, b = (x[0] for x in self._where(split(key)))
        for at in (a, b):
            held = np.flatnonzero(self.slots[at] == mark)
            if len(held):
                self.slots[at, held[0]] = 0
                self.items -= 1
                return True
        return False


def split(keys: bytes) -> np.ndarray:
    """Concatenated digests as (n, 2) uint64."""
    return np.frombuffer(keys, np.uint64).reshape(-1, 2)


def shard_of(key, shards: int):
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _loaded(rows: list) -> dict[int, CuckooFilter]:
    return {r["shard"]: CuckooFilter(r["buckets"], np.frombuffer(bytes(r["slots"]), np.uint16).reshape(-1, SLOTS), r["items"]) for r in rows}


def _accepts(filters: dict[int, CuckooFilter], shards: int, keys: list[bytes]) -> np.ndarray:
    """Whether the filter of its shard holds each key."""
    out = np.zeros(len(keys), bool)
    if keys and filters:
        digests = split(b"".join(keys))
        home = np.fromiter((_shard(k, shards) for k in keys), np.int64, len(keys))
        for n, f in filters.items():
            own = np.flatnonzero(home == n)
            out[own] = f.contains(digests[own])
    return out


def _shard(key: bytes, shards: int) -> int:
    """``shard_of`` in Python: XXH64 with seed 42 as a signed number."""
    h = xxhash.xxh64_intdigest(key, 42)
    return (h - (h >> 63 << 64)) % shards


@dataclass
class LineIndex:
    """``counts`` and ``filters`` as DataFrames; each update returns a new index."""

    spark: SparkSession
    min_docs: int = 10
    min_length: int = 1
    shards: int = 8
    counts: DataFrame | None = None
    filters: DataFrame | None = None

    def _delta(self, docs: DataFrame) -> DataFrame:
        """(key, refs) of the documents: the number of distinct ids that hold a key."""
        shortest = self.min_length

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                rows, keys = [], []
                for i, text in enumerate(as_bytes(part.column("text"))):
                    own = [k for k in {line_key(x) for x in text.split(b"\n")} if code_points(k) >= shortest]
                    keys += map(digest, own)
                    rows += [i] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), part.column("doc_id").take(pa.array(rows, pa.int64()))], names=["key", "doc_id"])

        pairs = docs.select("doc_id", "text").mapInArrow(held, T.StructType([T.StructField("key", T.BinaryType()), docs.schema["doc_id"]]))
        return pairs.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("refs"))

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._updated(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Takes the documents back; they must have been inserted."""
        return self._updated(docs, -1)

    def _updated(self, docs: DataFrame, sign: int) -> LineIndex:
        prepare(self.spark)
        threshold, shards = self.min_docs, self.shards
        delta = self._delta(docs)
        if self.counts is None:
            counts = checkpointed(delta.withColumn("refs", F.col("refs") * sign))
            moved = counts.where(F.col("refs") >= threshold).select("key", F.lit(True).alias("enters"))
            old = self.spark.createDataFrame([], FILTERS)
        else:
            both = self.counts.withColumnRenamed("refs", "old").join(delta.withColumnRenamed("refs", "by"), "key", "full")
            both = checkpointed(both.select("key", F.coalesce("old", F.lit(0)).alias("old"), (F.coalesce("old", F.lit(0)) + sign * F.coalesce("by", F.lit(0))).alias("refs")))
            counts = both.where("refs > 0").select("key", "refs")
            moved = both.where((F.col("old") >= threshold) != (F.col("refs") >= threshold)).select("key", (F.col("refs") >= threshold).alias("enters"))
            old = self.filters
        keyed = moved.withColumn("shard", shard_of("key", shards))
        held = counts.where(F.col("refs") >= threshold).select("key", shard_of("key", shards).alias("shard"))

        def change(key: tuple, state: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
            enters = [bytes(k) for k in changes.loc[changes.enters.astype(bool), "key"]]
            leaves = [bytes(k) for k in changes.loc[~changes.enters.astype(bool), "key"]]
            if len(state):
                row = state.iloc[0]
                f = CuckooFilter(int(row.buckets), np.frombuffer(row.slots, np.uint16).reshape(-1, SLOTS).copy(), int(row["items"]))
                for k in leaves:
                    f.delete(k)
                fits = f.items + len(enters) <= f.buckets * SLOTS * 0.85 and all(f.insert(k) for k in enters)
                slots, buckets, items = (f.slots.tobytes(), f.buckets, f.items) if fits else (None, f.buckets, -1)
            else:
                f = CuckooFilter.built(enters)
                slots, buckets, items = f.slots.tobytes(), f.buckets, f.items
            return pd.DataFrame({"shard": [key[0]], "buckets": [buckets], "items": [items], "slots": [slots]})

        filters = old.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(change, FILTERS)
        if self.counts is not None:

            def rebuild(key: tuple, state: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
                if len(state) and state["items"].iloc[0] >= 0:
                    return state
                f = CuckooFilter.built([bytes(k) for k in keys.key])
                return pd.DataFrame({"shard": [key[0]], "buckets": [f.buckets], "items": [f.items], "slots": [f.slots.tobytes()]})

            filters = checkpointed(filters)
            if filters.where("items < 0").limit(1).count():  # a shard outgrew its filter: made anew from the exact table
                filters = filters.groupBy("shard").cogroup(held.groupBy("shard")).applyInPandas(rebuild, FILTERS)
        return LineIndex(self.spark, threshold, self.min_length, shards, counts, checkpointed(filters))

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("refs") >= self.min_docs).select("key")

    def broadcastable(self, limit: int = BROADCAST_BYTES):
        """(filters, exceptions) as a broadcast value, or None beyond ``limit`` bytes."""
        size = self.filters.agg(F.coalesce(F.sum(F.length("slots")), F.lit(0))).first()[0]
        if size > limit:
            return None
        loaded, shards = self.spark.sparkContext.broadcast(_loaded(self.filters.collect())), self.shards

        def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_accepts(loaded.value, shards, as_bytes(batch.column("key"))), pa.bool_()))

        rarer = self.counts.where(F.col("refs") < self.min_docs).select("key").mapInArrow(accepted, "key binary")
        room = max(0, (limit - size) // 64)
        wrong = rarer.limit(room + 1).collect()  # one more than there is room for tells that the other way is needed
        if len(wrong) > room:
            return None
        return self.spark.sparkContext.broadcast((loaded.value, frozenset(bytes(r[0]) for r in wrong)))


def _cut(text: bytes, drop: set[bytes] | frozenset[bytes], shortest: int) -> tuple[list[bytes], int]:
    lines = text.split(b"\n")
    kept = [x for x in lines if code_points(k := line_key(x)) < shortest or k not in drop]
    return kept, len(lines)


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, min_docs: int = 10, min_length: int = 1, broadcast_limit: int = BROADCAST_BYTES, digests: bool = False) -> DataFrame:
    """Drops the lines whose key is in at least ``min_docs`` documents of the index (by default, of ``docs``).

    The result has the columns of ``docs`` with ``text`` rewritten, ``n_lines``
    (before) and ``n_dropped``; with ``digests``, only doc_id, the two counts
    and ``kept_sha256``.
    """
    spark = docs.sparkSession
    prepare(spark)
    if index is None:
        index = LineIndex(spark, min_docs, min_length, partitions(spark)).insert(docs)
    shortest, shards = index.min_length, index.shards
    docs = docs.drop("n_lines", "n_dropped", "kept_sha256")
    docs = docs.select("doc_id", "text") if digests else docs
    state = index.broadcastable(broadcast_limit)
    found = unused("hits", docs)
    source = docs if state is not None else _with_hits(docs, index, found)
    inputs = [c for c in docs.columns if c != "text"]
    out = T.StructType([f for f in docs.schema if f.name != "text"] + ([] if digests else [T.StructField("text", T.StringType())]) + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())] + ([T.StructField("kept_sha256", T.StringType())] if digests else []))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = as_bytes(part.column("text"))
            if state is not None:
                filters, wrong = state.value
                keys = list({k for t in texts for x in t.split(b"\n") if code_points(k := line_key(x)) >= shortest})
                marks = [digest(k) for k in keys]
                drop = {k for k, m, y in zip(keys, marks, _accepts(filters, shards, marks), strict=True) if y and m not in wrong}
                cut = [_cut(t, drop, shortest) for t in texts]
            else:
                hits = [{bytes(x) for x in h or ()} for h in part.column(found).to_pylist()]
                cut = []
                for t, h in zip(texts, hits, strict=True):
                    cut.append(_cut(t, {k for k in {line_key(x) for x in t.split(b"\n")} if digest(k) in h} if h else set(), shortest))
            kept = [b"\n".join(k) for k, _ in cut]
            n = pa.array([n for _, n in cut], pa.int64())
            dropped = pa.array([n - len(k) for k, n in cut], pa.int64())
            rest = [part.column(c) for c in inputs]
            own = [n, dropped, pa.array([hashlib.sha256(k).hexdigest() for k in kept])] if digests else [pa.array([k.decode() for k in kept]), n, dropped]
            yield pa.RecordBatch.from_arrays(rest + own, names=inputs + ([] if digests else ["text"]) + ["n_lines", "n_dropped"] + ["kept_sha256"] * digests)

    done = source.mapInArrow(rewrite, out)
    return done if digests else done.select(*[c for c in docs.columns], "n_lines", "n_dropped")


def _with_hits(docs: DataFrame, index: LineIndex, column: str) -> DataFrame:
    """The other way: distinct (text, key) pairs joined to the exact table, then back to the rows by the text's hash.

    Keys are salted by their text before the join, so that a line that a third of all documents hold does not gather.
    """
    shortest, mark = index.min_length, unused("mark", docs)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("mark", pa.string()), ("key", pa.binary())])
        for part in slices(batches):
            out = [(hashlib.sha256(t).hexdigest(), digest(k)) for t in set(as_bytes(part.column("text"))) for k in {line_key(x) for x in t.split(b"\n")} if code_points(k) >= shortest]
            yield table(schema, [m for m, _ in out], [k for _, k in out])

    each = docs.select("text").mapInArrow(pairs, "mark string, key binary").distinct().withColumn("salt", F.pmod(F.xxhash64("mark"), F.lit(SALTS)))
    frequent = index.frequent().withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = each.join(frequent, ["key", "salt"], "left_semi").groupBy("mark").agg(F.collect_list("key").alias(column)).withColumnRenamed("mark", mark)
    return docs.withColumn(mark, F.sha2(F.coalesce("text", F.lit("")), 256)).join(found, mark, "left").drop(mark)
