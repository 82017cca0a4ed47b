"""Helpers shared by the training-data operators.

Python stages run as ``mapInArrow`` over record batches.  A batch is worked
through in slices of bounded bytes, so one task holds a few MB of words at a
time however long the documents are.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows handed to a Python worker at once (documents are a few kB on average).
BATCH_ROWS = 500
#: Bytes of text that a worker splits into words at once.
SLICE_BYTES = 2 << 20
#: A driver-side value is broadcast only up to this many bytes.
BROADCAST_BYTES = 64 << 20
#: The white space of the word and line contracts: [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"
MASK64 = (1 << 64) - 1


def prepare(spark: SparkSession) -> None:
    """Session settings that the Python stages rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        # one machine has no other folder to share than its own
        spark.sparkContext.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new name for a folder of intermediate tables, in the place that driver and executors share."""
    prepare(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate tables that nothing reads any longer."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path: a third of a checkpoint's bytes, and removable."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now: it does so only when the driver's heap is collected, which few large steps may never cause."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or with marks before it what no column of the frames is called."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with files in the folder that all executors share."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt anew by ``key`` if it is read in fewer parts than there are cores: one unsplittable file would keep one core busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if 2 * df.rdd.getNumPartitions() < cores else df


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) only, with a null text as an empty one; other columns are pruned from the scan."""
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def replace_columns(df: DataFrame, **columns) -> DataFrame:
    """``withColumns`` in which a new column takes the place of a clashing one."""
    return df.withColumns(columns)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices of about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def runs(lengths: np.ndarray) -> np.ndarray:
    """Start offsets of consecutive groups, with the total at the end."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Rows of one key from which a join does not gather them.
HOT = 50_000


def joined_by_key(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``values`` (one row a key), where a key may have a third of all rows.

    The values of keys with over HOT rows, at most one for each HOT rows, are
    broadcast while they are few; the other keys' rows meet by their hash.
    """
    hot = checkpointed(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select(key))
    few = hot.count()
    if not few or few * 64 > BROADCAST_BYTES:
        return rows.join(values, key)
    often = rows.join(F.broadcast(values.join(F.broadcast(hot), key, "left_semi")), key)
    return often.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(values, key))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def rolling(h: np.ndarray, base: int, k: int) -> np.ndarray:
    """Polynomial hashes of each k consecutive values, modulo 2^64."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(base, n), dtype=np.uint64)])
    return mix64((sums[k:] - sums[:-k]) * powers(pow(base, -1, 1 << 64), n - k + 1))


#: Links that one task joins up; more take rounds over all executors.
ONE_TASK_LINKS = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of a graph given as (a, b), b < a.

    Up to ONE_TASK_LINKS counted links are joined up in one task of an
    executor.  More take alternating large-star and small-star steps: each
    points nodes at smaller neighbours; links never grow in number, and the
    steps end when a round changes nothing.  Work is shared by the nodes'
    hash; a node's neighbours only meet as aggregates.
    """
    edges = checkpointed(edges)
    if edges.count() <= ONE_TASK_LINKS:
        kinds = T.StructType([T.StructField("node", edges.schema["a"].dataType), T.StructField("root", edges.schema["a"].dataType)])
        return edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_united, kinds)

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before, now = None, mark(edges)
    while before != now:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a > b").distinct()
        edges = checkpointed(small)
        before, now = now, mark(edges)
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits that tell rows of different ids or texts apart, nulls included."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("i"), F.col(doc_id).cast("string")), F.lit("n")), F.lit(":"), F.coalesce(F.md5(text), F.lit("null")))))


def most_common(counts: DataFrame, column: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted values as uint64, their n as int32, at most 2^31 - 1) of (column, n): all with at least such an n that at most ``most`` are listed."""
    counts = checkpointed(counts.withColumn("step", F.floor(F.log2("n") * 4).cast("int")))
    least, total = None, 0
    for step, rows in sorted(counts.groupBy("step").count().collect(), reverse=True):  # at most four rows for each doubling
        total += rows
        if total > most:
            break
        least = step
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    got = counts.where(F.col("step") >= least).select(column, "n").toArrow()
    values, n = got.column(column).to_numpy().view(np.uint64), np.minimum(got.column("n").to_numpy(), 2**31 - 1).astype(np.int32)
    order = np.argsort(values)
    return values[order], n[order]


#: Bytes of a bitmap that are made in one place.
PIECE = 4096


def bitmap_size(entries: int, limit: int) -> int:
    """Bits, a power of two: 64 an entry, but at most ``limit`` bytes and at least one piece."""
    size = PIECE * 8
    while size < 64 * entries and size * 2 <= limit * 8:
        size *= 2
    return size


def bitmap(bits: DataFrame, size: int) -> np.ndarray:
    """The bits (column ``bit``) of a map of ``size`` bits, as bytes; pieces are made on executors, so the driver gets size / 8 bytes."""
    span = PIECE * 8

    def piece(key: tuple, rows: pa.Table) -> pa.Table:
        out = np.zeros(span, bool)
        out[rows.column("bit").to_numpy() % span] = True
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(size // 8, np.uint8)
    for at, data in bits.distinct().withColumn("piece", F.floor(F.col("bit") / span)).groupBy("piece").applyInArrow(piece, "piece long, bits binary").collect():
        out[at * PIECE : (at + 1) * PIECE] = np.frombuffer(bytes(data), np.uint8)
    return out


def marked(bits: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _united(edges: pa.Table) -> pa.Table:
    """(node, root) of the nodes that are not the smallest of their part."""
    parent: dict = {}

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for a, b in zip(edges.column("a").to_pylist(), edges.column("b").to_pylist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    kind = edges.schema.field("a").type
    return pa.table({"node": pa.array(nodes, kind), "root": pa.array([root(x) for x in nodes], kind)})


def remainder_of_id(doc_id: str, mod: int):
    """crc32 of the id's decimal text modulo ``mod``: the fold that a contract names; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(mod))


def fold_of(ids: list, mod: int) -> list[int]:
    """The same remainder on the Python side; a null id counts as empty text."""
    import zlib

    return [zlib.crc32(b"" if x is None else str(x).encode()) % mod for x in ids]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, limit: int) -> DataFrame:
    """(doc_id, text, label): at most ``limit`` labelled rows outside the held-out fold.

    The sample is the ``limit`` smallest hashes of doc_id, so it is bounded,
    repeatable and independent of partitioning.  A doc_id labelled twice
    counts once, with its larger label; null labels and ids are ignored.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder_of_id("doc_id", mod) != held_out))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias(label))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(limit)
    )
    # bounded by ``limit`` rows of two numbers
    return keyed_text(docs).join(F.broadcast(chosen), "doc_id")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(curve, gradient)
    return w


class Adam:
    """The usual first-order optimiser, for the small models that are trained on the driver."""

    def __init__(self, shapes: list[tuple], rate: float):
        self.rate, self.step = rate, 0
        self.m, self.v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]

    def move(self, weights: list[np.ndarray], gradients: list[np.ndarray]) -> None:
        self.step += 1
        for w, g, m, v in zip(weights, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
