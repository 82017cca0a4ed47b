"""Substring dedup with a log-structured fingerprint index.

A window is ``width`` consecutive words.  Its fingerprint is the least hash of
the ``GRAM``-word sequences inside it, so equal windows have equal fingerprints,
neighbouring windows mostly share one, and about one in fourteen sequences is
stored.  Every batch of documents becomes one immutable run of (fingerprint,
occurrences), sorted by fingerprint; a new run is merge-joined with the
standing ones, which tells the fingerprints that occur more than once; runs
are compacted into one when there are ``FAN_IN`` of them.

A shared fingerprint only makes windows candidates.  They are verified by
128-bit hashes of their whole word sequence: a window is repeated if its
sequence starts at two or more places.  An index that ``keeps`` windows
stores, beside each run and sorted like it, the hashes of its windows by
fingerprint.  A later batch is then verified against those, and no earlier
document is read again (``dedup_batch``).  ``dedup_substrings`` judges all
documents of a table by each other; they are at hand, so it keeps none.

Candidates are told by a bitmap of the shared fingerprints, of ``limit`` bytes
at most: the fuller it is, the more windows are verified in vain, with the
same result.  Sequences that repeat within a batch of rows are settled there,
and each such batch sends any sequence once.  Windows go to shards by
fingerprint; those of the commonest fingerprints are dealt by their own hash
too, so that a passage that a third of all documents share does not gather in
one task.  The number of shards follows from the windows that the index
counted.

Defined cases: a null or empty text has no words; a text shorter than a
window keeps all words; repeated rows count as places of their own, so whole
texts of a window or more that occur twice lose all words; rows are told
apart by id and text, so ids may be null, repeated or of any type; columns of
any name are kept, but for those that the result adds; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import BROADCAST_BYTES, as_bytes, bitmap, bitmap_size, checkpointed, marked, mix64, most_common, partitions, prepare, remove_folder, rolling, row_key, runs, shared_folder, slices, table, unused

WIDTH = 35
GRAM = 8
#: Runs that are compacted into one.
FAN_IN = 4
#: Windows that one task verifies.
SHARD_WINDOWS = 1 << 21
#: Occurrences of a fingerprint that are dealt together.
DEALT = 256
#: Starts of windows that stand for two places and have nothing to be told, and of windows of an earlier batch.
SETTLED, EARLIER = -1, -2
BASE_A, BASE_B, BASE_G = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
RUN, KEPT = "fp long, n long", "fp long, windows binary"
PAIR = [("a", np.uint64), ("b", np.uint64)]


class Words:
    """The words of several texts, hashed; sequences never run across texts."""

    def __init__(self, texts: list[bytes], width: int = WIDTH):
        self.words = [t.split() for t in texts]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        self.starts = runs(self.counts)
        self.hash = np.array([h for w in self.words for h in map(xxhash.xxh64_intdigest, w)], np.uint64)
        self.width, n = width, len(self.hash)
        self.gram = min(GRAM, width)
        ends = np.repeat(self.starts[1:], self.counts)
        left = ends - np.arange(n)  # words from here to the text's end
        #: where windows start
        self.at = np.flatnonzero(left >= width)
        self.owner = np.searchsorted(self.starts, self.at, "right") - 1

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprint of each window, and the hash of each sequence that is the least of some window."""
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        grams = rolling(self.hash, BASE_G, self.gram)
        span = self.width - self.gram + 1
        least = _sliding(grams, span, np.minimum)
        valid = np.zeros(len(least), bool)
        valid[self.at] = True
        # a sequence counts where it equals the least of a window around it: the greatest of the windows' least values reaches it
        reach = np.concatenate([np.zeros(span - 1, np.uint64), np.where(valid, least, np.uint64(0)), np.zeros(span - 1, np.uint64)])
        chosen = (_sliding(reach, span, np.maximum) == grams) & _near(valid, span)
        return least[self.at], grams[chosen]

    def windows(self, chosen: np.ndarray) -> np.ndarray:
        """(n, 2) hashes of the windows with these indexes in ``at``."""
        at = self.at[chosen]
        twice = mix64(self.hash ^ np.uint64(0x8EBC6AF09C88C6E3))
        return np.column_stack([rolling(self.hash, BASE_A, self.width)[at], rolling(twice, BASE_B, self.width)[at]])


def _sliding(x: np.ndarray, k: int, of) -> np.ndarray:
    """``of`` over each k consecutive values, by doubling."""
    if len(x) < k:
        return x[:0]
    done = 1
    while done * 2 <= k:
        x = of(x[:-done], x[done:])
        done *= 2
    return of(x[: len(x) - (k - done)], x[k - done :]) if done < k else x


def _near(valid: np.ndarray, span: int) -> np.ndarray:
    """Sequences inside at least one window."""
    total = np.concatenate([[0], np.cumsum(valid)])
    n = len(valid) + span - 1
    i = np.arange(n)
    return total[np.minimum(i + 1, len(valid))] > total[np.clip(i - span + 1, 0, len(valid))]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in the windows that start there."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


@dataclass(frozen=True)
class FingerprintIndex:
    """Runs as folders of Parquet under ``path``; every change gives a new index and leaves the standing runs as they are."""

    spark: SparkSession
    path: str
    width: int = WIDTH
    keeps: bool = True
    runs: tuple[str, ...] = ()
    #: folders with the fingerprints that merge-joins found to occur more than once
    shared: tuple[str, ...] = ()
    #: folders with the windows of each run
    windows: tuple[str, ...] = ()

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, width: int = WIDTH, keeps: bool = True) -> FingerprintIndex:
        return cls(spark, path or shared_folder(spark, "fingerprints"), width, keeps)

    def _write(self, df: DataFrame, kind: str, sort: bool = True) -> str:
        to = shared_folder(self.spark, kind).rsplit("/", 1)[1]
        (df.sortWithinPartitions("fp") if sort else df).write.parquet(f"{self.path}/{to}")
        return f"{self.path}/{to}"

    def _read(self, folders: tuple[str, ...], schema: str = RUN) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def append(self, docs: DataFrame) -> FingerprintIndex:
        """A new run of the documents' fingerprints, merge-joined with the standing runs."""
        width, keeps = self.width, self.keeps

        def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("fp", pa.int64()), ("n", pa.int64())] + [("windows", pa.binary())] * keeps)
            for part in slices(batches):
                w = Words(as_bytes(part.column("text")), width)
                least, chosen = w.fingerprints()
                values, n = np.unique(chosen, return_counts=True)
                held = []
                if keeps:
                    # every stored sequence is the least of some window: one list of windows each
                    pairs = np.unique(np.rec.fromarrays([least, *w.windows(np.arange(len(least))).T], names="fp,a,b"))
                    cut = np.searchsorted(pairs["fp"], values)
                    both = np.column_stack([pairs["a"], pairs["b"]])
                    held = [[both[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(both)], strict=True)]]
                yield table(schema, values.view(np.int64), n, *held)

        found = docs.select("text").mapInArrow(stored, RUN + ", windows binary" * keeps)
        windows = self.windows
        if keeps:
            # sorted files of each task, without a shuffle; the run is made from their small columns
            windows = (*windows, self._write(found, "windows"))
            found = self._read(windows[-1:], RUN)
        run = self._write(found.groupBy("fp").agg(F.sum("n").alias("n")), "run")
        fresh = self._read((run,))
        if self.runs:
            old = self._read(self.runs).groupBy("fp").agg(F.sum("n").alias("old"))
            hits = fresh.join(old.hint("merge"), "fp", "left").select("fp", (F.col("n") + F.coalesce("old", F.lit(0))).alias("n"))
        else:
            hits = fresh
        shared = self._write(hits.where("n > 1"), "shared", sort=False)
        out = replace(self, runs=(*self.runs, run), shared=(*self.shared, shared), windows=windows)
        return out.compact() if len(out.runs) >= FAN_IN else out

    def compact(self) -> FingerprintIndex:
        """One sorted run in place of all; the lists of shared fingerprints and of windows become one too."""
        run = self._write(self._read(self.runs).groupBy("fp").agg(F.sum("n").alias("n")), "run")
        shared = self._write(self._read(self.shared).groupBy("fp").agg(F.max("n").alias("n")), "shared")
        windows = (self._write(self._read(self.windows, KEPT).repartitionByRange("fp"), "windows"),) if self.windows else ()
        return replace(self, runs=(run,), shared=(shared,), windows=windows)

    def candidates(self) -> DataFrame:
        return self._read(self.shared).groupBy("fp").agg(F.max("n").alias("n"))

    def earlier(self, found: DataFrame) -> DataFrame:
        """The kept windows with these fingerprints."""
        return self._read(self.windows, KEPT).join(found.select("fp"), "fp", "left_semi")

    def remove(self) -> None:
        remove_folder(self.spark, self.path)


@dataclass(frozen=True)
class Dealer:
    """Which windows are candidates, and the shard of each; the same on every executor."""

    bitmap: np.ndarray
    common: tuple[np.ndarray, np.ndarray]
    shards: int

    def candidates(self, fp: np.ndarray) -> np.ndarray:
        return np.flatnonzero(marked(self.bitmap, _bit(fp, len(self.bitmap) * 8)))

    def shard(self, fp: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """By fingerprint, as neighbours mostly share theirs; windows of a common one also by their own hash."""
        spread = fp
        if len(self.common[0]):
            at = np.minimum(np.searchsorted(self.common[0], fp), len(self.common[0]) - 1)
            times = np.where(self.common[0][at] == fp, -(-self.common[1][at] // DEALT), 1).astype(np.uint64)
            spread = fp ^ mix64(windows[:, 0] % times)
        return (mix64(spread) % np.uint64(self.shards)).astype(np.int64)


def _bit(fp: np.ndarray, size: int) -> np.ndarray:
    return (mix64(fp ^ np.uint64(BASE_B)) & np.uint64(size - 1)).astype(np.int64)


def dealer(index: FingerprintIndex, found: DataFrame, limit: int = BROADCAST_BYTES) -> Dealer:
    """For the shared fingerprints ``found`` (fp, n)."""
    rows, places = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    stored = index._read(index.runs).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = bitmap_size(rows, limit)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bit(batch.column("fp").to_numpy().view(np.uint64), size))], names=["bit"])

    own = bitmap(found.select("fp").mapInArrow(bits, "bit long"), size)
    # a sequence is the least one of about half the windows around it
    span = (index.width - min(GRAM, index.width) + 2) // 2
    expected = span * (places + stored * rows / size)
    common = most_common(found.where(F.col("n") > DEALT), "fp", limit // 16)
    return Dealer(own, common, max(partitions(index.spark), -(-int(expected) // SHARD_WINDOWS)))


def repeated(docs: DataFrame, index: FingerprintIndex, limit: int = BROADCAST_BYTES, earlier: FingerprintIndex | None = None) -> DataFrame:
    """(key, starts): for each row of ``docs`` (key, text), the starts of its repeated windows as packed 32-bit numbers.

    ``docs`` must be what the index holds beyond ``earlier``; windows of the
    latter are those that it keeps.
    """
    spark, width = docs.sparkSession, index.width
    found = index.candidates()
    own = spark.sparkContext.broadcast(dealer(index, found, limit))  # twice ``limit`` bytes at most
    sent = pa.schema([("shard", pa.int32()), ("key", pa.binary()), ("starts", pa.binary()), ("hashes", pa.binary())])
    fields = "shard int, key binary, starts binary, hashes binary"

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = own.value
        for part in slices(batches):
            times: dict[bytes, int] = {}
            texts = {}
            for key, text in zip(part.column("key").to_pylist(), as_bytes(part.column("text")), strict=True):
                times[key] = times.get(key, 0) + 1
                texts[key] = text
            keys = list(texts)
            w = Words(list(texts.values()), width)
            fp, _ = w.fingerprints()
            chosen = deal.candidates(fp)
            if not len(chosen):
                continue
            h = w.windows(chosen)
            _, first, back, n = np.unique(h.view(PAIR).ravel(), return_index=True, return_inverse=True, return_counts=True)
            owner, start = w.owner[chosen], (w.at - w.starts[w.owner])[chosen].astype(np.int32)
            again = np.array([times[k] > 1 for k in keys], bool)[owner]
            # settled here; one of them still tells the others, as two
            local = (np.bincount(back, weights=1 + again, minlength=len(n)) > 1)[back]
            lead = np.zeros(len(chosen), bool)
            lead[first] = True
            out: list[tuple] = []
            settled = np.flatnonzero(local)
            for k, rows in _groups(owner[settled], settled):
                out.append((int.from_bytes(keys[k][:4], "little") % deal.shards, keys[k], start[rows].tobytes(), b""))
            open_ = np.flatnonzero(lead)
            shard = deal.shard(fp[chosen[open_]], h[open_])
            for k, rows in _groups(owner[open_] * deal.shards + shard, open_):
                told = np.where(local[rows], np.int32(SETTLED), start[rows]).astype(np.int32)
                out.append((k % deal.shards, keys[k // deal.shards], told.tobytes(), h[rows].tobytes()))
            yield table(sent, *[list(c) for c in zip(*out, strict=True)])

    def standing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = own.value
        for batch in batches:
            held = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in batch.column("windows").to_pylist()]
            if not held:
                continue
            h = np.concatenate(held)
            shard = deal.shard(np.repeat(batch.column("fp").to_numpy().view(np.uint64), [len(x) for x in held]), h)
            out = [(k, None, np.full(len(rows), EARLIER, np.int32).tobytes(), h[rows].tobytes()) for k, rows in _groups(shard, np.arange(len(h)))]
            yield table(sent, *[list(c) for c in zip(*out, strict=True)])

    def verified(key: tuple, rows: pa.Table) -> pa.Table:
        starts = [np.frombuffer(x, np.int32) for x in rows.column("starts").to_pylist()]
        hashes = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in rows.column("hashes").to_pylist()]
        asked = np.array([len(x) > 0 for x in hashes], bool)
        flat = np.concatenate([h for h in hashes if len(h)] or [np.zeros((0, 2), np.uint64)])
        told = np.concatenate([s for s, a in zip(starts, asked, strict=True) if a] or [np.zeros(0, np.int32)])
        order = np.lexsort((flat[:, 1], flat[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (flat[order[1:]] != flat[order[:-1]]).any(1)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        weight = np.bincount(group, weights=np.where(told == SETTLED, 2, 1), minlength=1)
        yes = (weight[group] > 1) & (told >= 0) if len(group) else np.zeros(0, bool)
        out, at = [], 0
        for s, a in zip(starts, asked, strict=True):
            if a:
                out.append(s[yes[at : at + len(s)]].tobytes())
                at += len(s)
            else:
                out.append(s.tobytes())
        keep = pa.array([len(x) > 0 for x in out], pa.bool_())
        return pa.table({"key": rows.column("key"), "starts": pa.array(out, pa.binary())}).filter(keep)

    rows = docs.mapInArrow(candidates, fields)
    if earlier is not None:
        rows = rows.union(earlier.earlier(found).mapInArrow(standing, fields))
    shards = own.value.shards
    reply = rows.repartition(shards, "shard").groupBy("shard").applyInArrow(verified, "key binary, starts binary")
    return reply.groupBy("key").agg(F.collect_list("starts").alias("starts"))


def _groups(key: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    cut = np.flatnonzero(np.diff(key)) + 1
    for part, k in zip(np.split(rows, cut), key[np.concatenate([[0], cut]).astype(np.int64)] if len(key) else [], strict=False):
        yield int(k), part


def _rewritten(docs: DataFrame, keyed: DataFrame, key: str, hits: DataFrame, width: int, digests: bool) -> DataFrame:
    """``keyed`` is ``docs`` with the row key; see ``dedup_substrings``."""
    starts = unused("starts", docs)
    joined = keyed.join(hits.select(F.col("key").alias(key), F.col("starts").alias(starts)), key, "left")
    inputs = [c for c in docs.columns if c != "text"]
    added = ["n_words", "n_removed", "kept_sha256"] if digests else ["text", "n_words", "n_removed"]

    def rewrite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            n, removed, kept = [], [], []
            for t, s in zip(as_bytes(part.column("text")), part.column(starts).to_pylist(), strict=True):
                words = t.split()
                n.append(len(words))
                if s:
                    gone = covered(np.frombuffer(b"".join(s), np.int32).astype(np.int64), width, len(words))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept.append(b" ".join(words))
                removed.append(n[-1] - len(words))
            counts = [pa.array(n, pa.int64()), pa.array(removed, pa.int64())]
            own = [*counts, pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())] if digests else [pa.array([k.decode() for k in kept], pa.string()), *counts]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in inputs] + own, names=inputs + added)

    types = {"text": T.StringType(), "kept_sha256": T.StringType(), "n_words": T.LongType(), "n_removed": T.LongType()}
    done = joined.select(*inputs, "text", starts).mapInArrow(rewrite, T.StructType([docs.schema[c] for c in inputs] + [T.StructField(c, types[c]) for c in added]))
    return done if digests else done.select(*docs.columns, "n_words", "n_removed")


def _prepared(docs: DataFrame, digests: bool) -> tuple[DataFrame, DataFrame, str]:
    """(docs without the columns that are added, the same with a row key, that key's name)."""
    prepare(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    docs = docs.select("doc_id", "text") if digests else docs
    key = unused("key", docs)
    return docs, docs.withColumn(key, row_key()), key


def dedup_substrings(docs: DataFrame, width: int = WIDTH, batches: int = 2, limit: int = BROADCAST_BYTES, digests: bool = False) -> DataFrame:
    """``docs`` without the words of repeated windows: ``text`` rewritten (kept words joined by one space), ``n_words`` and ``n_removed``.

    The documents enter the index in ``batches`` batches, dealt by the text's
    hash.  With ``digests``, only doc_id, the counts and ``kept_sha256``.
    """
    docs, keyed, key = _prepared(docs, digests)
    index = FingerprintIndex.create(docs.sparkSession, width=width, keeps=False)
    for k in range(batches):
        index = index.append(docs.where(F.pmod(F.xxhash64("text"), F.lit(batches)) == k) if batches > 1 else docs)
    hits = checkpointed(repeated(keyed.select(F.col(key).alias("key"), "text"), index, limit))
    index.remove()
    return _rewritten(docs, keyed, key, hits, width, digests)


def dedup_batch(docs: DataFrame, index: FingerprintIndex, limit: int = BROADCAST_BYTES, digests: bool = False) -> tuple[DataFrame, FingerprintIndex]:
    """``docs`` without the words of windows that are repeated in them or were in an earlier batch, and the index with this batch.

    Only the index tells of earlier batches; their documents are not needed
    and stay as they are.
    """
    if not index.keeps:
        raise ValueError("the index keeps no windows to verify a new batch with")
    docs, keyed, key = _prepared(docs, digests)
    grown = index.append(docs)
    hits = checkpointed(repeated(keyed.select(F.col(key).alias("key"), "text"), grown, limit, index))
    return _rewritten(docs, keyed, key, hits, index.width, digests), grown


__all__ = ["FingerprintIndex", "Words", "covered", "dedup_batch", "dedup_substrings", "repeated"]
