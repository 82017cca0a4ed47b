"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of ``width`` words (an item of fewer words is one
window).  Containment must be whole, so of a window's words, ordered by
rarity, the first alone is a necessary prefix token: a document can hold the
window only where it holds that word.  Rarity is a word's number of windows
in the benchmark, longer words first among equals.

Document words are joined to the prefix tokens.  A bitmap of the tokens, each
with a neighbour in its window, keeps from the shuffle what cannot match; it
takes ``limit`` bytes at most, and the fuller it is the more words are joined
in vain, with the same result.  A match gives the one place where the window
could start: the length bound asks that it lies inside the document, the
positional bound that the window's first and last words stand at their
places, and what is left is verified word by word.  Windows that take up to
``limit`` bytes are broadcast.  Of more, the documents' side is salted, as a
third of all documents may hold one passage, and the benchmark's side, far
smaller, is repeated for each salt.

Defined cases: null and empty texts have no words and no hits, an item
without words has no window; repeated item rows with the same id count once,
and the windows of an item without id mark words but no item; rows are told
apart by id and text, so ids may be null, repeated or of any type, and
repeated rows are judged alike; columns of any name are kept, but for the
four that the result adds; empty tables give empty results or results without
hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import BROADCAST_BYTES, as_bytes, bitmap, bitmap_size, checkpointed, marked, mix64, prepare, row_key, runs, slices, table, unused

WIDTH = 10
SALTS = 16
#: What a window takes in a broadcast table, about.
WINDOW_BYTES = 1024
#: Upper case to lower, and every ASCII byte that is no letter or digit to a space.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Which neighbour goes with a token: the word after it, the word before it (at a window's end), or none (a window of one word).
AFTER, BEFORE, ALONE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F


def words(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(words, items, token, place): the distinct windows, the ids of their items, and where in the window its prefix token stands."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item", pa.string()), ("words", pa.list_(pa.string()))])
        for part in slices(batches):
            out = []
            for item, text in zip(part.column("item").to_pylist(), as_bytes(part.column("text")), strict=True):
                ws = [w.decode() for w in words(text)]
                out += [(item, ws[at : at + width]) for at in range(max(1, len(ws) - width + 1) if ws else 0)]
            yield table(schema, [i for i, _ in out], [w for _, w in out])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    held = checkpointed(items.mapInArrow(cut, "item string, words array<string>").groupBy("words").agg(F.collect_set("item").alias("items")))
    count = held.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct("n", (-F.octet_length("word")).alias("short"), "word")
    token = held.select("words", F.explode(F.array_distinct("words")).alias("word")).join(count, "word").groupBy("words").agg(F.min(rank).alias("first"))
    place = (F.array_position("words", F.col("first.word")) - 1).cast("int")
    return checkpointed(held.join(token, "words").select("words", "items", F.col("first.word").alias("token"), place.alias("place")))


def _bit(token: np.ndarray, neighbour: np.ndarray | int, side: int, size: int) -> np.ndarray:
    return (mix64((token ^ np.uint64(side)) * np.uint64(AFTER) + neighbour) & np.uint64(size - 1)).astype(np.int64)


def _hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))


def _bits_of(held: DataFrame, size: int) -> DataFrame:
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [[w.encode() for w in ws] for ws in batch.column("words").to_pylist()]
            place = batch.column("place").to_pylist()
            token = _hashes([ws[p] for ws, p in zip(each, place, strict=True)])
            near = [(ws[p + 1], 0) if p + 1 < len(ws) else (ws[p - 1], 1) if p else (b"", 2) for ws, p in zip(each, place, strict=True)]
            other, side = _hashes([w for w, _ in near]), np.array([k for _, k in near], np.int64)
            out = np.where(side == 0, _bit(token, other, AFTER, size), np.where(side == 1, _bit(token, other, BEFORE, size), _bit(token, 0 * token, ALONE, size)))
            yield pa.RecordBatch.from_arrays([pa.array(out)], names=["bit"])

    return held.select("words", "place").mapInArrow(bits, "bit long")


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(key, spans, items) of the rows of ``docs`` (key, text) that hold a window: the (start, end) words of each, and the sorted ids of their items."""
    held = windows(benchmark, width)
    several = held.count()
    size = bitmap_size(several, limit)
    own = docs.sparkSession.sparkContext.broadcast(bitmap(_bits_of(held, size), size))  # ``limit`` bytes at most
    schema = pa.schema([("key", pa.binary()), ("token", pa.string()), ("at", pa.int32()), ("before", pa.int32()), ("around", pa.list_(pa.string()))])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = own.value
        for part in slices(batches):
            keys, each = part.column("key").to_pylist(), [words(t) for t in as_bytes(part.column("text"))]
            starts = runs(np.array([len(w) for w in each], np.int64))
            h = _hashes(list(chain.from_iterable(each)))
            if not len(h):
                continue
            owner = np.repeat(np.arange(len(each)), np.diff(starts))
            inner = owner[1:] == owner[:-1]
            found = marked(bits, _bit(h, 0 * h, ALONE, size))
            found[:-1] |= inner & marked(bits, _bit(h[:-1], h[1:], AFTER, size))
            found[1:] |= inner & marked(bits, _bit(h[1:], h[:-1], BEFORE, size))
            out = []
            for i in np.flatnonzero(found).tolist():
                d = int(owner[i])
                at, ws = i - int(starts[d]), each[d]
                low = max(0, at - width + 1)
                out.append((keys[d], ws[at].decode(), at, at - low, [w.decode() for w in ws[low : at + width]]))
            if out:
                yield table(schema, *[list(c) for c in zip(*out, strict=True)])

    sides = docs.mapInArrow(candidates, "key binary, token string, at int, before int, around array<string>")
    if several * WINDOW_BYTES <= limit:
        pairs = sides.join(F.broadcast(held), "token")  # counted
    else:
        asked = held.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        pairs = sides.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))).join(asked, ["token", "salt"])
    start, n = F.col("before") - F.col("place"), F.size("words")
    met = pairs.where((start >= 0) & (start + n <= F.size("around")))
    met = met.where((F.get("around", start) == F.get("words", F.lit(0))) & (F.get("around", start + n - 1) == F.get("words", n - 1)))
    met = met.where(F.slice("around", F.greatest(start + 1, F.lit(1)), n) == F.col("words"))
    begin = F.col("at") - F.col("place")
    return met.groupBy("key").agg(F.collect_set(F.struct(begin.alias("start"), (begin + n).alias("end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, limit: int = BROADCAST_BYTES, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of ``docs`` with n_words, n_hit, items (sorted ids as strings) and contaminated.

    The four take the place of columns of the same names.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("n_words", "n_hit", "items", "contaminated")
    keep = docs.columns if keep is None else keep
    key, spans = unused("key", docs), unused("spans", docs)
    keyed = docs.withColumn(key, row_key())
    found = checkpointed(hits(keyed.select(F.col(key).alias("key"), "text"), benchmark, width, limit).select(F.col("key").alias(key), F.col("spans").alias(spans), "items"))
    if found.count() * 512 <= BROADCAST_BYTES:
        found = F.broadcast(found)  # counted; a hit document has some tens of spans at most times
    inputs = [*dict.fromkeys([*keep, key])]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n = pa.array([len(words(t)) for t in as_bytes(part.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in inputs), n], names=[*inputs, "n_words"])

    rows = keyed.select(*dict.fromkeys([*inputs, "text"])).mapInArrow(counted, T.StructType([*(keyed.schema[c] for c in inputs), T.StructField("n_words", T.LongType())]))
    covered = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1))))
    n_hit = F.coalesce(F.size(covered), F.lit(0)).cast("long")
    out = rows.join(found, key, "left").withColumn("n_hit", F.when(F.col(spans).isNotNull(), n_hit).otherwise(F.lit(0)))
    return out.select(*keep, "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.col("n_hit") > 0).alias("contaminated"))
