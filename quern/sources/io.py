"""Reading and writing: CSV, JSON, JDBC, verified dumps, fixtures, generated rows, byte keys."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def import_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", schema: str | None = None) -> DataFrame:
    """Types are inferred (long, double, boolean, time, text) unless a schema is given, which saves a pass; rows with another number of fields are dropped (``csv_rejects`` tells which)."""
    reader = spark.read.option("header", header).option("sep", delimiter).option("mode", "DROPMALFORMED").option("enforceSchema", False)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def _is_object(line: str) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def csv_rejects(spark: SparkSession, path: str, schema: str, header: bool = True, delimiter: str = ",") -> DataFrame:
    """(line): what ``import_csv`` with this schema drops, of files whose fields have no line breaks."""
    names = T.StructType.fromDDL(schema).names
    rows = spark.read.text(path).where(F.trim("value") != "")
    rows = rows.where(F.col("value") != delimiter.join(names)) if header else rows
    parsed = F.from_csv("value", f"{schema}, __line string", {"sep": delimiter, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__line"})
    return rows.select(parsed.alias("r")).where("r.__line is not null").select(F.col("r.__line").alias("line"))


def import_json(spark: SparkSession, path: str, schema: str | None = None, times: bool = False) -> DataFrame:
    """An array of objects or one object a line; without a schema, ``times`` turns text columns whose values are all in ISO form into timestamps, at the cost of a pass."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    # a file whose first line is a whole object has one on each line; else values go over lines
    reader = spark.read.option("multiLine", not (first is not None and _is_object(first[0])))
    df = (reader.schema(schema) if schema else reader).json(path)
    texts = [c for c, t in df.dtypes if t == "string"] if times and not schema else []
    if not texts:
        return df
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    fits = df.agg(*[F.coalesce(F.bool_and(F.col(c).rlike(iso)), F.lit(False)).alias(c) for c in texts]).first()
    return df.withColumns({c: F.col(c).try_cast("timestamp") for c in texts if fits[c]})


def import_jdbc(spark: SparkSession, url: str, table: str, partition: str | None = None, low: int = 0, high: int = 0, parts: int = 1, batch: int = 1000, **options: str) -> DataFrame:
    """A table of another database; with a numeric ``partition`` column it is read in ``parts`` ranges at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(batch), **options)
    if partition:
        reader = reader.options(partitionColumn=partition, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


# What SQLite's declared types hold.
SQLITE_TYPES = (("INT", "long"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BOOL", "boolean"))


def import_sqlite(spark: SparkSession, path: str, table: str, batch: int = 1000, parts: int | None = None) -> DataFrame:
    """A table of a SQLite file that all executors can open; ranges of row numbers are read at once, ``batch`` rows at a time, and NULL is a missing value."""
    import sqlite3

    name = '"' + table.replace('"', '""') + '"'
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        columns = db.execute(f"PRAGMA table_info({name})").fetchall()
        low, high = db.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {name}").fetchone()
    kinds = {c[1]: next((k for mark, k in SQLITE_TYPES if mark in c[2].upper()), "string") for c in columns}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    chosen = ", ".join('"' + c.replace('"', '""') + '"' for c in kinds)
    parts = parts or spark.sparkContext.defaultParallelism
    width = -(-(high - low + 1) // parts) or 1
    read = {"long": int, "double": float, "boolean": bool, "string": lambda v: v if isinstance(v, str) else str(v), "binary": lambda v: v if isinstance(v, bytes) else str(v).encode()}

    def rows(ranges):
        import pandas as pd

        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for r in ranges:
                for part in r["id"]:
                    start = low + int(part) * width
                    found = db.execute(f"SELECT {chosen} FROM {name} WHERE rowid >= ? AND rowid < ?", (start, start + width))
                    while held := found.fetchmany(batch):
                        yield pd.DataFrame({c: pd.Series([None if v is None else read[k](v) for v in values], dtype=object) for (c, k), values in zip(kinds.items(), zip(*held, strict=True), strict=True)})

    return spark.range(0, parts, 1, parts).mapInPandas(rows, schema)


def import_sqlite_script(spark: SparkSession, script: str, table: str, path: str) -> DataFrame:
    """Runs SQLite statements into a new file at ``path``, which all executors can open, and reads one of its tables."""
    import sqlite3

    with sqlite3.connect(path) as db:
        db.executescript(script)
    return import_sqlite(spark, path, table)


def import_sql(spark: SparkSession, script: str) -> DataFrame:
    """Statements separated by semicolons; the last one's result."""
    parts = [s for s in (x.strip() for x in script.split(";")) if s]
    for s in parts[:-1]:
        spark.sql(s)
    return spark.sql(parts[-1])


def export_csv(df: DataFrame, path: str, fields: Sequence[str] | None = None) -> None:
    (df.select(*fields) if fields else df).write.option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias(column))


def as_csv(df: DataFrame, fields: Sequence[str], column: str = "csv") -> DataFrame:
    """A line a row; fields with commas, quotes or breaks are quoted."""

    def cell(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.rlike('[",\n\r]'), F.concat(F.lit('"'), F.regexp_replace(v, '"', '""'), F.lit('"'))).otherwise(v)

    return df.select(F.concat_ws(",", *map(cell, fields)).alias(column))


def as_markdown(df: DataFrame, fields: Sequence[str], column: str = "markdown") -> DataFrame:
    """A table line a row, without the heading (see ``markdown_heading``)."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|") for c in fields]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias(column))


def markdown_heading(fields: Sequence[str]) -> str:
    return f"| {' | '.join(fields)} |\n|{'---|' * len(fields)}"


# dumps


def write_dump(df: DataFrame, path: str, key: str = "id", name: str = "", version: str = "1.0") -> None:
    """A folder with records (JSON lines), a header and a manifest with a hash over all of them.

    The hash is a sum over record hashes, so records are neither sorted nor
    gathered; one that is changed, added or lost shows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("string").alias("id"), F.to_json(F.struct(*sorted(df.columns))).alias("record"))
    rows.write.parquet(f"{path}/records")
    header = spark.createDataFrame([("v1", version, name, df.schema.json())], "format string, schema_version string, name string, schema string")
    header.coalesce(1).write.json(f"{path}/header")
    payload = _digest(spark.read.parquet(f"{path}/records"))
    sealed = payload.crossJoin(F.broadcast(_header_digest(header)))  # one row each
    sealed.withColumn("combined_hash", F.sha2(F.concat("header_hash", "payload_hash"), 256)).coalesce(1).write.json(f"{path}/manifest")


def _digest(rows: DataFrame) -> DataFrame:
    """One row: record count, bytes, and the hash of the records' summed hashes."""
    h = F.sha2(F.concat_ws(":", F.coalesce("id", F.lit("")), F.coalesce("record", F.lit(""))), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    return rows.agg(F.count(F.lit(1)).alias("record_count"), F.coalesce(F.sum(F.octet_length("record")), F.lit(0)).alias("payload_size"), F.sha2(F.concat_ws(":", *[F.coalesce(p, F.lit(0)).cast("string") for p in parts]), 256).alias("payload_hash"))


def _header_digest(header: DataFrame) -> DataFrame:
    return header.select(F.sha2(F.concat_ws("\n", *header.columns), 256).alias("header_hash"))


def verify_dump(spark: SparkSession, path: str) -> bool:
    """Whether the records and the header are those that the manifest tells."""
    told = spark.read.json(f"{path}/manifest").first()
    got = _digest(spark.read.parquet(f"{path}/records")).first()
    header = spark.read.schema("format string, schema_version string, name string, schema string").json(f"{path}/header")
    return (told["payload_hash"], told["record_count"], told["payload_size"], told["header_hash"]) == (got["payload_hash"], got["record_count"], got["payload_size"], _header_digest(header).first()[0])


def restore_dump(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    if verify and not verify_dump(spark, path):
        raise ValueError(f"{path} is damaged")
    schema = T.StructType.fromJson(json.loads(spark.read.json(f"{path}/header").first()["schema"]))
    return spark.read.parquet(f"{path}/records").select(F.from_json("record", schema).alias("r")).select("r.*")


def restore_tagged(spark: SparkSession, path: str, kinds: Mapping[str, str]) -> DataFrame:
    """Rows of a one-file dump ``{header, records: [{storage: {field: {tag: value}}}]}``, with a Spark type for each field wanted."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "struct<records:array<struct<storage:map<string,string>>>>")["records"]).alias("r"))
    one = F.col("r.storage")

    def value(name: str, kind: str) -> Column:
        text = one[name]
        inner = F.element_at(F.map_values(F.from_json(text, "map<string,string>")), 1)
        return F.coalesce(inner, text).try_cast(kind).alias(name)

    return raw.select(*[value(n, k) for n, k in kinds.items()])


# fixtures and generated rows


def load_fixtures(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return import_json(spark, path, schema)


snapshot, restore = export_json, load_fixtures


def generate(spark: SparkSession, n: int, fields: Mapping[str, Column], parts: int | None = None) -> DataFrame:
    """n rows from expressions over ``id`` (0 to n - 1)."""
    return spark.range(0, n, 1, parts or spark.sparkContext.defaultParallelism).withColumns(dict(fields))


def random_choice(values: Sequence, seed: int) -> Column:
    """One of the values for each ``id``; the same in every run, however the rows are dealt."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(values))).cast("int"))


def random_number(low: int, high: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(high - low + 1)) + F.lit(low)


def seeded(spark: SparkSession, n: int, seed: int = 0, start: str = "2025-01-01") -> DataFrame:
    """Rows with a title, status, priority, date and tags."""
    return generate(spark, n, {
        "title": F.concat(random_choice(["Fix", "Add", "Update", "Remove", "Check"], seed), F.lit(" item "), F.col("id").cast("string")),
        "status": random_choice(["open", "in_progress", "closed"], seed + 1), "priority": random_number(1, 5, seed + 2),
        "created_at": F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(random_number(0, 364, seed + 3).cast("int")),
        "tags": F.array_distinct(F.array(random_choice(["bug", "feature", "urgent"], seed + 4), random_choice(["ui", "backend", "docs"], seed + 5))),
    })


# byte keys


def kv_put(table: DataFrame, entries: DataFrame) -> DataFrame:
    """(key string, value binary); a key's new value takes the place of the old one."""
    from quern.operators.dml import upsert

    return upsert(table, entries, "key")


def kv_get(table: DataFrame, key: str) -> bytes | None:
    row = table.where(F.col("key") == key).select("value").first()
    return None if row is None else bytes(row[0])


def kv_delete(table: DataFrame, key: str) -> DataFrame:
    return table.where(F.col("key") != key)


def unpack_floats(packed: Column, dims: int) -> Column:
    """Little-endian 32-bit floats in binary as array<float>, from the bits: no Python."""

    def one(i: Column) -> Column:
        part = F.hex(F.substring(packed, i * 4 + 1, 4))
        big = F.concat(F.substring(part, 7, 2), F.substring(part, 5, 2), F.substring(part, 3, 2), F.substring(part, 1, 2))
        bits = F.conv(big, 16, 10).cast("long")
        sign = F.when(F.shiftright(bits, 31) == 1, -1.0).otherwise(1.0)
        exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255)).cast("int")
        fraction = bits.bitwiseAND(F.lit((1 << 23) - 1)).cast("double") / float(1 << 23)
        return (sign * F.when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(-126.0))).otherwise((1 + fraction) * F.pow(F.lit(2.0), (exponent - 127).cast("double")))).cast("float")

    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), one)


def stream_rows(df: DataFrame, where: Column | None = None):
    """Rows one by one; one partition at a time is on the driver."""
    return (df if where is None else df.where(where)).toLocalIterator()


def inferred_types(documents: DataFrame, column: str) -> DataFrame:
    """(field, type) of JSON objects in a text column; "mixed" where a field has several."""
    pairs = documents.select(F.explode(F.from_json(column, "map<string,string>")).alias("field", "value"))
    kind = F.when(F.col("value").isNull(), F.lit(None)).when(F.col("value").rlike(r"^-?\d+$"), "long").when(F.col("value").rlike(r"^-?\d*\.?\d+([eE][+-]?\d+)?$"), "double").when(F.col("value").isin("true", "false"), "boolean").when(F.col("value").startswith("["), "array").when(F.col("value").startswith("{"), "object").otherwise("string")
    return pairs.select("field", kind.alias("type")).where("type is not null").groupBy("field").agg(F.when(F.count_distinct("type") > 1, "mixed").otherwise(F.min("type")).alias("type"))
