"""Near copies: documents whose sets of k-word shingles have a Jaccard likeness of at least 0.8.

An exact set-similarity join; no pair of that likeness is lost.  A set of n
shingles can only be alike to another if one of its first
n - ceil(0.8 n) + 1 shingles, in an order that holds for all texts, is among
the first ones of the other too.  The order puts the shingles that many
texts hold last, so that few unlike texts meet.  That list of common
shingles is bounded by ``COMMON`` entries; it only saves work, since every
order gives the same pairs.

Texts that share such a shingle form a group, named by its smallest member.
Members that no other one of the group is near enough to in size drop out.
The others meet as bitmaps of the parity of their shingles' hashes, about two
bits a shingle: two sets differ in at least as many shingles as their bitmaps
in bits, so pairs whose bitmaps differ in more than alike sets could are
unlike for certain.  What hangs together by the other pairs is a new group,
the same one wherever its members met; a member without such a pair drops
out.  So what is sent of a text is bounded by its first shingles, however
many unlike texts share them.

Only such a group meets with its members' whole sets, and pairs are tested
exactly, but those that tested pairs have joined already: what counts is
which texts hang together, so a group of copies costs about one test a
member.  Groups of over ``FILTERED`` shingles skip the bitmaps.  Groups
of over ``GROUP`` shingles are tested in blocks, each with the group's first
member; then the members that are still apart from the group's largest part
are tested against all blocks.  So no task holds an unbounded group, and no
pair is left out for the size of its group.

Equal sets are one member from the start.  Members are named by 128-bit
hashes of their sets; the 64-bit names that find groups only choose
candidates.

Defined cases: upper-case A-Z equals lower case; a text with fewer words than
a shingle has one, of all its words; texts without words (null, empty) are
copies of each other; repeated rows are copies; rows of one doc_id with
different texts are rows of their own; a null doc_id comes after all others;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import BROADCAST_BYTES, as_bytes, checkpointed, components, joined_by_key, mix64, most_common, partitions, prepare, release, remove_folder, rolling, row_key, runs, slices, stored, table, unused

SHINGLE, SIMILARITY = 5, 0.8
#: Entries of the list of common shingles (12 bytes each).
COMMON = 1 << 21
#: Shingles that are tested together.
GROUP = 1 << 17
#: Shingles of a group whose bitmaps are compared in one task: no more bytes than the whole sets of GROUP.
FILTERED = 16 * GROUP
#: Bytes of text whose shingles one task counts, on average.
COUNTED_TOGETHER = 8 << 20
#: Bytes of text whose shingles a worker holds at once.
SLICE = 1 << 20
#: Rows that share a shingle from which they are salted.
SALTED = 4096
BASE = 0xA0761D6478BD642F
#: Bits by which shingles are counted: two that share them only count as more common than they are.
COUNTED = np.uint64((1 << 48) - 1)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    words = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    starts = runs(counts)
    grams = rolling(np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, starts[-1]), BASE, k)
    out = []
    for w, at, n in zip(words, starts.tolist(), counts.tolist(), strict=False):
        if n >= k:
            out.append(np.unique(grams[at : at + n - k + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(w))] if n else [], np.uint64))
    return out


def name_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _node(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def needed(n: int, similarity: float) -> int:
    """The least shingles that a set of n must share with one that is alike."""
    return math.ceil(similarity * n - 1e-9)


def _new_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list[bytes], list[np.ndarray]]]:
    """(names, sets) slice by slice, each set once a task; sets without shingles are left out."""
    seen: set[bytes] = set()  # 16 bytes a text of the task
    for part in slices(batches, limit=SLICE):
        names, kept = [], []
        for s in shingle_sets(as_bytes(part.column("text")), k):
            if len(s) and (name := name_of(s)) not in seen:
                seen.add(name)
                names.append(name)
                kept.append(s)
        if kept:
            yield names, kept


def common_shingles(docs: DataFrame, k: int = SHINGLE, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of 48 bits, number of texts) of the shingles that most texts hold: all with at least so many texts that at most ``most`` are listed."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(partitions(spark), -(-size // COUNTED_TOGETHER))

    def dealt(tokens: np.ndarray, n: np.ndarray | None) -> pa.RecordBatch:
        bucket = (tokens % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        pieces = np.split(order, cut[1:])
        counts = [None if n is None else n[x].tobytes() for x in pieces]
        return table(schema, bucket[order[cut]], [tokens[x].tobytes() for x in pieces], counts)

    schema = pa.schema([("bucket", pa.int64()), ("tokens", pa.binary()), ("n", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what several texts of a slice hold is added up for the whole task, so that no token comes from it very often
        several = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

        def summed() -> tuple[np.ndarray, np.ndarray]:
            values, back = np.unique(np.concatenate(several[0]), return_inverse=True)
            return values, np.bincount(back, weights=np.concatenate(several[1]), minlength=len(values)).astype(np.int64)

        for _, sets in _new_sets(batches, k):
            tokens, n = np.unique(np.concatenate(sets) & COUNTED, return_counts=True)
            if (n == 1).any():
                yield dealt(tokens[n == 1], None)
            several[0].append(tokens[n > 1])
            several[1].append(n[n > 1])
            if len(several[0]) > 16:
                values, n = summed()
                if len(values) > COUNTED_TOGETHER // 16:
                    yield dealt(values, n)
                    values, n = values[:0], n[:0]
                several = [values], [n]
        values, n = summed()
        if len(values):
            yield dealt(values, n)

    def added(key: tuple, rows: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()]
        n = [np.ones(len(t), np.int64) if x is None else np.frombuffer(x, np.int64) for t, x in zip(tokens, rows.column("n").to_pylist(), strict=True)]
        values, back = np.unique(np.concatenate(tokens), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate(n)).astype(np.int64)
        return pa.table({"token": pa.array(values[total > 2].view(np.int64)), "n": pa.array(total[total > 2])})

    sent = docs.select("text").mapInArrow(count, "bucket long, tokens binary, n binary")
    held = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(added, "token long, n long")
    return most_common(held, "token", most)


def first_shingles(sets: list[np.ndarray], common: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, owner, texts that hold it or 0) of every set's first ones: uncommon shingles by hash, then common ones by their number of texts."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    held = np.zeros(len(flat), np.int64)
    if len(common[0]):
        short = flat & COUNTED
        at = np.minimum(np.searchsorted(common[0], short), len(common[0]) - 1)
        held = np.where(common[0][at] == short, common[1][at], 0)
    order = np.lexsort((flat, held, owner))
    place = np.arange(len(flat)) - runs(sizes)[owner]
    count = sizes - np.array([needed(int(n), similarity) for n in sizes], np.int64) + 1
    chosen = order[place < count[owner]]
    return flat[chosen], owner[chosen], held[chosen]


def groups(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, most: int = COMMON) -> tuple[DataFrame, str]:
    """(lead, node, size), distinct: texts that share one of their first shingles, by the least of them; and the folder that they are read from."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, k, most))
    release(docs.sparkSession)
    schema = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("node", pa.int64()), ("size", pa.int32())])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sets in _new_sets(batches, k):
            tokens, owner, held = first_shingles(sets, common.value, similarity)
            nodes = np.array([_node(x) for x in names], np.int64)[owner]
            sizes = np.array([len(s) for s in sets], np.int32)[owner]
            several = -(-held // SALTED)
            salt = np.where(several > 1, (mix64(nodes.view(np.uint64)) % np.maximum(several, 1).astype(np.uint64)).astype(np.int64), -1)
            yield table(schema, tokens.view(np.int64), salt.astype(np.int32), nodes, sizes)

    own = W.partitionBy("token", "salt")
    held = docs.select("text").mapInArrow(first, "token long, salt int, node long, size int")
    held = held.withColumn("lead", F.min("node").over(own)).withColumn("last", F.max("node").over(own)).where((F.col("lead") < F.col("last")) | (F.col("salt") >= 0))
    held, folder = stored(held.groupBy("lead", "node", F.when(F.col("salt") >= 0, F.col("token")).alias("hot")).agg(F.max("size").alias("size")), "groups")
    # the salts of one shingle have one lead
    hot = held.where("hot is not null")
    leads = hot.groupBy("hot").agg(F.min("lead").alias("first"), F.max("node").alias("last")).where("first < last").select("hot", "first")
    plain = held.where("hot is null").select("lead", "node", "size")
    salted = hot.join(leads, "hot").select(F.col("first").alias("lead"), "node", "size")
    return plain.union(salted).groupBy("lead", "node").agg(F.max("size").alias("size")), folder


def _near_in_size(members: DataFrame, similarity: float) -> DataFrame:
    """Without the members of a group that no other one is near enough to in size; large groups, which blocks will hold, stay as they are."""
    weight = members.groupBy("lead").agg(F.sum("size").alias("weight"))
    placed = members.join(weight, "lead")
    order = W.partitionBy("lead", F.when(F.col("weight") > GROUP, F.col("node"))).orderBy("size", "node")
    before, after = F.lag("size").over(order), F.lead("size").over(order)
    fits = F.coalesce(before >= F.col("size") * similarity - 1e-9, F.lit(False)) | F.coalesce(after * similarity - 1e-9 <= F.col("size"), F.lit(False))
    return placed.withColumn("fits", fits | (F.col("weight") > GROUP)).where("fits").select("lead", "node", "size")


def parity(shingles: np.ndarray) -> bytes:
    """A bit for each value of the hashes' last bits: whether an odd number of shingles has it; a power of two of bits, 64 and one a shingle at least."""
    width = max(64, 1 << (len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1, bitorder="little").tobytes()


def maybe_alike(lead: np.ndarray, size: np.ndarray, bits: list[bytes], similarity: float) -> np.ndarray:
    """For each row its part's first row: what hangs together by pairs of one lead whose sizes and bitmaps alike sets could have."""
    order = np.lexsort((size, lead))
    lead, size = lead[order], size[order]
    words = np.array([len(bits[i]) // 8 for i in order], np.int64)
    # at each width the bitmaps of that width, and the next wider ones folded: the halves' exclusive or is what the half width gives
    at, place = {}, {}
    for w in np.unique(words).tolist():
        own, wider = np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)
        x = np.frombuffer(b"".join(bits[order[i]] for i in own), np.uint64).reshape(-1, w)
        y = np.frombuffer(b"".join(bits[order[i]] for i in wider), np.uint64).reshape(-1, 2 * w)
        at[w] = np.concatenate([x, y[:, :w] ^ y[:, w:]])
        place[w] = np.zeros(len(words), np.int64)
        place[w][np.concatenate([own, wider])] = np.arange(len(own) + len(wider))
    part = np.arange(len(lead))
    left, step = np.arange(len(lead) - 1), 0
    while len(left):
        step += 1
        left = left[left + step < len(lead)]
        # sizes ascend within a lead: who is too far from the next row is too far from all later ones
        left = left[(lead[left] == lead[left + step]) & (size[left] >= size[left + step] * similarity - 1e-9)]
        i = left[part[left] != part[left + step]]
        near = np.zeros(len(i), bool)
        for w in np.unique(words[i]).tolist():
            # alike sizes are a doubling of width apart at most; others are not told apart here
            one = np.flatnonzero((words[i] == w) & (words[i + step] <= 2 * w))
            for some in np.array_split(one, max(1, len(one) * w >> 17)):
                a, b = i[some], i[some] + step
                apart = np.bitwise_count(at[w][place[w][a]] ^ at[w][place[w][b]]).sum(1, dtype=np.int64)
                near[some] = apart <= (size[a] + size[b]) * ((1 - similarity) / (1 + similarity)) + 1e-6
        near |= words[i + step] > 2 * words[i]
        a, b = i[near], i[near] + step
        while len(a):
            np.minimum.at(part, np.maximum(part[a], part[b]), np.minimum(part[a], part[b]))
            while (part != part[part]).any():
                part = part[part]
            open_ = part[a] != part[b]
            a, b = a[open_], b[open_]
    out = np.empty(len(order), np.int64)
    out[order] = order[part]
    return out


def _near_in_bits(members: DataFrame, docs: DataFrame, similarity: float, k: int) -> DataFrame:
    """(lead, node, size), distinct, of the members that may be alike to others by their bitmaps, by the least of those that hang together; very large groups stay as they are."""
    weight = members.groupBy("lead").agg(F.sum("size").alias("weight"))
    total = weight.where(F.col("weight") <= FILTERED).agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    calls = max(partitions(docs.sparkSession), -(-total // FILTERED))
    placed = members.join(weight, "lead")
    schema = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("bits", pa.binary())])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sets in _new_sets(batches, k):
            own = [i for i, s in enumerate(sets) if len(s) <= FILTERED]
            yield table(schema, [_node(names[i]) for i in own], [len(sets[i]) for i in own], [parity(sets[i]) for i in own])

    def regrouped(rows: pa.Table) -> pa.Table:
        lead, node, size = (rows.column(c).to_numpy() for c in ("lead", "node", "size"))
        part = maybe_alike(lead, size.astype(np.int64), rows.column("bits").to_pylist(), similarity)
        kept = np.flatnonzero(np.bincount(part, minlength=len(part))[part] > 1)
        least = np.full(len(part), np.iinfo(np.int64).max)
        np.minimum.at(least, part, node)
        return pa.table({"lead": pa.array(least[part][kept], pa.int64()), "node": pa.array(node[kept], pa.int64()), "size": pa.array(size[kept], pa.int32())})

    of = docs.select("text").mapInArrow(bits, "node long, size int, bits binary").distinct()
    small = placed.where(F.col("weight") <= FILTERED).select("lead", "node").join(of, "node")
    call = F.pmod(F.xxhash64("lead"), F.lit(calls)).cast("int")
    small = small.withColumn("call", call).repartition(calls, "call").groupBy("call").applyInArrow(regrouped, "lead long, node long, size int")
    return placed.where(F.col("weight") > FILTERED).select("lead", "node", "size").union(small).groupBy("lead", "node").agg(F.max("size").alias("size"))


def members_of_groups(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, most: int = COMMON) -> DataFrame:
    """(lead, node, size): the groups whose members' whole sets are tested."""
    spark = docs.sparkSession
    found, found_in = groups(docs, similarity, k, most)
    release(spark)
    near, near_in = stored(_near_in_size(found, similarity), "groups")
    remove_folder(spark, found_in)
    members = checkpointed(_near_in_bits(near, docs, similarity, k))
    remove_folder(spark, near_in)
    release(spark)
    return members


def tested(part: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """(i, j) of alike sets, enough of them to join all parts that alike sets join; ``part`` numbers those that are joined already."""
    sizes = np.array([len(s) for s in sets], np.int64)
    edges = runs(sizes)
    _, flat, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # shingles that only one set has count for nothing but its size
    several = n > 1
    kept = several[flat]
    edges = np.concatenate([[0], np.cumsum(kept)])[edges]
    flat = (np.cumsum(several) - 1)[flat[kept]]
    shared = np.diff(edges)
    part, out, own = part.copy(), [], np.zeros(int(several.sum()), bool)
    for i in range(len(sets) - 1):
        least = np.ceil((sizes[i] + sizes) * (similarity / (1 + similarity)) - 1e-9)
        fits = (part != part[i]) & (np.minimum(shared, shared[i]) >= least)
        fits[: i + 1] = False
        near = np.flatnonzero(fits)
        if not len(near):
            continue
        own[flat[edges[i] : edges[i + 1]]] = True
        if shared[near].sum() * 4 < len(flat):
            both = np.array([own[flat[edges[j] : edges[j + 1]]].sum() for j in near], np.int64)
        else:
            total = runs(own[flat])
            both = total[edges[near + 1]] - total[edges[near]]
        own[flat[edges[i] : edges[i + 1]]] = False
        for j in near[both / (sizes[i] + sizes[near] - both) >= similarity].tolist():
            if part[i] != part[j]:
                part[part == part[j]] = part[i]
                out.append((i, j))
    return out


def _links(members: DataFrame, similarity: float, shingles: int) -> DataFrame:
    """(a, b) names, b < a, of alike sets within each (lead, block, chunk) of (lead, block, chunk, name, part, shingles)."""
    spark = members.sparkSession
    # several blocks a call, so that small ones don't cost a call each
    calls = max(partitions(spark), -(-shingles // GROUP))
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def test(rows: pa.Table) -> pa.Table:
        place = rows.select(["lead", "block", "chunk"]).append_column("row", pa.array(np.arange(rows.num_rows)))
        place = place.sort_by([("lead", "ascending"), ("block", "ascending"), ("chunk", "ascending")])
        key = np.column_stack([place.column(c).to_numpy() for c in ("lead", "block", "chunk")])
        order = place.column("row").to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]])).tolist()
        names, parts, sets = (rows.column(c) for c in ("name", "part", "shingles"))
        found: set[tuple[bytes, bytes]] = set()
        for a, b in zip(cut, cut[1:], strict=False):
            each = {names[i].as_py(): i for i in order[a:b].tolist()}  # a set comes once from each task that holds it
            if len(each) < 2:
                continue
            own = list(each)
            _, part = np.unique(np.array([parts[i].as_py().hex() for i in each.values()]), return_inverse=True)
            for i, j in tested(part, [np.frombuffer(sets[i].as_py(), np.uint64) for i in each.values()], similarity):
                found.add((max(own[i], own[j]), min(own[i], own[j])))
        out = sorted(found)
        return pa.Table.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], schema=schema)

    call = F.pmod(F.xxhash64("lead", "block", "chunk"), F.lit(calls)).cast("int")
    return members.withColumn("call", call).repartition(calls, "call").groupBy("call").applyInArrow(test, "a binary, b binary").distinct()


def copy_parts(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, most: int = COMMON) -> DataFrame:
    """(node, root) names of the sets that are joined to others."""
    spark = docs.sparkSession
    members = members_of_groups(docs, similarity, k, most)
    ids = checkpointed(members.select("node").distinct())
    if ids.count() * 32 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)  # counted: one number a text; beyond that, sets are shuffled to their ids
    weight = members.groupBy("lead").agg(F.sum("size").alias("weight"))
    total = weight.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    large = checkpointed(weight.where(F.col("weight") > GROUP).select("lead", F.ceil(F.col("weight") / GROUP).cast("int").alias("blocks")))
    some = large.count()
    large = F.broadcast(large) if some * 32 <= BROADCAST_BYTES else large

    schema = pa.schema([("node", pa.int64()), ("name", pa.binary()), ("shingles", pa.binary())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sets in _new_sets(batches, k):
            yield table(schema, [_node(x) for x in names], names, [s.tobytes() for s in sets])

    sets = docs.select("text").mapInArrow(whole, "node long, name binary, shingles binary").join(ids, "node", "left_semi")
    own = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
    every = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    placed = members.join(large, "lead", "left")
    first = placed.withColumn("block", F.explode(F.when(F.col("node") == F.col("lead"), every).otherwise(F.array(own))))
    first = first.join(sets, "node").select("lead", "block", F.lit(0).alias("chunk"), "name", F.col("name").alias("part"), "shingles")
    found = checkpointed(_links(first, similarity, total))
    linked = components(found)
    if not some:
        return linked
    # large groups: members outside the largest part, in chunks, against all blocks
    inside = members.join(large, "lead").withColumn("block", own).join(sets.select("node", "name"), "node")
    inside = inside.join(linked.withColumnRenamed("node", "name"), "name", "left").withColumn("part", F.coalesce("root", "name")).drop("root")
    inside = checkpointed(inside.groupBy("lead", "name", "node", "part", "size", "block", "blocks").agg(F.count(F.lit(1)).alias("times")))
    share = inside.groupBy("lead", "part").agg(F.sum("size").alias("weight"))
    most_of = share.groupBy("lead").agg(F.max_by("part", F.struct("weight", "part")).alias("largest"), (F.sum("weight") - F.max("weight")).alias("rest")).where("rest > 0")
    most_of = checkpointed(most_of.withColumn("chunks", F.ceil(F.col("rest") / GROUP).cast("int")))
    if not most_of.limit(1).count():
        return linked
    apart = inside.join(most_of, "lead")
    chunk = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")
    as_block = apart.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    as_chunk = apart.where(F.col("part") != F.col("largest")).withColumn("chunk", chunk).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = as_block.unionByName(as_chunk).select("lead", "block", "chunk", "node", "name", "part", "size").distinct()
    load = pairs.agg(F.sum("size")).first()[0]
    pairs = pairs.join(sets.select(F.col("node"), F.col("name").alias("of"), "shingles"), "node").where(F.col("name") == F.col("of"))
    more = checkpointed(_links(pairs.select("lead", "block", "chunk", "name", "part", "shingles"), similarity, load))
    return components(found.union(more)) if more.limit(1).count() else linked


def _named(docs: DataFrame, k: int) -> DataFrame:
    """(key, doc_id, name) of every row."""
    prepare(docs.sparkSession)
    rows = docs.select(row_key().alias("key"), "doc_id", "text")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            names = pa.array([name_of(s) for s in shingle_sets(as_bytes(part.column("text")), k)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), names], names=["key", "doc_id", "name"])

    return checkpointed(rows.mapInArrow(name, T.StructType([T.StructField("key", T.BinaryType()), docs.schema["doc_id"], T.StructField("name", T.BinaryType())])))


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, most: int = COMMON) -> DataFrame:
    """doc_id and component_id of every row: the smallest doc_id that pairs of at least that likeness reach."""
    rows = _named(docs, k)
    linked = copy_parts(docs, similarity, k, most)
    sets = rows.groupBy("name").agg(F.min("doc_id").alias("first")).join(linked, F.col("name") == F.col("node"), "left").select("name", "first", F.coalesce("root", "name").alias("part"))
    first = sets.groupBy("part").agg(F.min("first").alias("component_id"))
    return joined_by_key(rows, sets.join(first, "part").select("name", "component_id"), "name").select("doc_id", "component_id")


def _with_parts(linked: DataFrame, rows: DataFrame, joined: DataFrame) -> DataFrame:
    """``linked`` names, with those of rows that share a part of ``joined`` (key, part) linked too."""
    held = checkpointed(rows.select("key", "name").distinct().join(joined.distinct(), "key").select("name", "part").distinct())
    first = held.groupBy("part").agg(F.min("name").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("part", "first")
    more = joined_by_key(held, first, "part").where("name > first").select(F.col("name").alias("a"), F.col("first").alias("b"))
    return components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more).distinct())


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, most: int = COMMON, joined: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest doc_id (nulls last), of equal ids the smallest key.

    Rows that ``joined`` (key as ``row_key`` gives it, part) puts in one part
    count as near copies too; groups are what both kinds of links reach.
    """
    rows = _named(docs, k)
    linked = copy_parts(docs, similarity, k, most)
    if joined is not None:
        linked = _with_parts(linked, rows, joined)
    # rows meet as minima by set, and sets by group, so that a group of any size gathers nowhere
    sets = rows.groupBy("name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    sets = sets.join(linked, F.col("name") == F.col("node"), "left").withColumn("part", F.coalesce("root", "name"))
    first = sets.groupBy("part").agg(F.min("first").alias("first")).select(F.col("first.key").alias("key"))
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    gone = checkpointed(counted.select("key").join(first, "key", "left_anti"))
    if gone.count() * 64 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)  # counted: 16 bytes a row and its place
    key = unused("key", docs)
    kept = docs.withColumn(key, row_key()).join(gone.withColumnRenamed("key", key), key, "left_anti")
    again = checkpointed(counted.where("n > 1").select(F.col("key").alias(key)))
    if again.limit(1).count():
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates([key]))
    return kept.select(*docs.columns)
