"""Change feeds and live results on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHANGES = "change_type string, id string, collection string, ts timestamp"


def change_feed(spark: SparkSession, path: str, schema: str = CHANGES, files: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def filtered(changes: DataFrame, condition: Column) -> DataFrame:
    """Changes that fit; deletions always pass, since their rows are gone."""
    return changes.where((F.col("change_type") == "delete") | F.coalesce(condition, F.lit(False)))


def observe(changes: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "50 milliseconds") -> StreamingQuery:
    """Runs ``on_batch`` for each batch of changes; without ``every``, for what is there now, then stops."""
    writer = changes.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def live(changes: DataFrame, query: Callable[[], DataFrame], on_results: Callable[[DataFrame], None], checkpoint: str, every: str | None = "50 milliseconds") -> StreamingQuery:
    """Evaluates the query anew after each batch of changes."""
    return observe(changes, lambda _df, _n: on_results(query()), checkpoint, every)


def current(operations: DataFrame, key: str = "id", clock: tuple[str, ...] = ("counter", "node"), kind: str = "change_type") -> DataFrame:
    """The state after a log of changes: of each key the last row by the clock, without deleted ones."""
    columns = [c for c in operations.columns if c not in (key, *clock)]
    last = operations.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*clock)).alias("last"))
    return last.select(key, "last.*").where(F.col(kind) != "delete").drop(kind)


def since(operations: DataFrame, counter: int, node: str = "", clock: tuple[str, str] = ("counter", "node")) -> DataFrame:
    """Operations after a point of the clock, each operation id once."""
    c, n = clock
    return operations.where((F.col(c) > counter) | ((F.col(c) == counter) & (F.col(n) > node))).dropDuplicates(["op_id"])


def deduplicated(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once while it is within the lateness bound."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, time: str, length: str, late: str | None, *aggregates: Column, keys: tuple[str, ...] = (), slide: str | None = None) -> DataFrame:
    """Aggregates by window of event time; works on batches too (``late`` None)."""
    source = stream.withWatermark(time, late) if late else stream
    out = source.groupBy(F.window(time, length, slide).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(stream: DataFrame, time: str, gap: str, late: str | None, *aggregates: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates by runs of events with no gap as long as ``gap``."""
    source = stream.withWatermark(time, late) if late else stream
    out = source.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def drained(result: DataFrame, to: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that its source holds now and reads what it wrote.

    Append mode writes Parquet.  Complete and update modes write each batch's
    rows with its number, and the last batch (or the last row of a key, for the
    caller to choose) counts.
    """
    spark = result.sparkSession
    if mode == "append":
        result.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(to)

    def keep(df: DataFrame, n: int) -> None:
        df.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{to}/batch={n}")

    result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.parquet(to).drop("batch")
    if mode == "complete":
        return every.join(F.broadcast(every.agg(F.max("__batch").alias("__batch"))), "__batch", "left_semi").drop("__batch")
    return every
