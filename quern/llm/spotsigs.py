"""Document fingerprints by SpotSigs, in DataFrame functions only.

A signature is a chain of ``CHAIN`` content words that begins right after a
common word, together with that word, the anchor.  The text's beginning is
an anchor too, so every text with a content word has a signature; a text
without one has a single signature of its own.  A fingerprint is the sorted
set of a text's signature hashes (32 bits each, as hex).

Fingerprints are compared by Jaccard likeness.  ``similar_pairs``, which looks
for alike pairs among all, partitions them by set length: sets whose lengths
differ too much cannot be alike enough and never meet.  Within a range of
lengths only the rarest signatures of each set, as many as one of them must
be shared, are joined, and only pairs whose lengths fit are compared.
``fingerprints`` is given its pairs (a text and its edited one, a text and the
next) and has to tell their likeness however small, so there nothing is to be
partitioned or pruned.

Defined cases: a null text is empty; an empty text has the fingerprint of
the empty string; equal texts have equal fingerprints and likeness 1;
repeated rows are fingerprinted alike, and as rows of one id follow each other
in the order of their texts, each is the next document of the one before; a
null doc_id sorts after all others
(it is its own last document); ids are numbers; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_BYTES, checkpointed, prepare

CHAIN = 2
SIMILARITY = 0.8
#: Consecutive ids that are ordered together.
SPAN = 256
#: Span heads that one task orders.
ONE_TASK = 4096

# Common words of English, German, French and Spanish.
COMMON = (
    "the of and to in a is it that was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their if do will each how them then she many some so these would other into has more her two him see could no than been its who now my over did down only way may said".split()
    + "der die das und ist von zu den mit dem des ein eine auf für im nicht als auch es an werden aus er hat dass sie nach wird bei noch wie einer um am sind so zum war haben nur oder aber vor zur bis mehr durch man dann sich".split()
    + "le la les de du des et un une est que qui dans en pour pas sur au par plus ce il elle avec se son sa ses ou mais nous vous ils sont été être avoir fait tout comme aux ne".split()
    + "el los las y que una por con para del lo su al como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde".split()
)


def words_of(text: Column) -> Column:
    """Lower-case words: runs of letters and digits."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted set of signature hashes (array<int>: 32 bits, less 2^31) of a text that is not null."""

    def of(words: Column) -> Column:
        content = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: ~F.get(words, i).isin(*COMMON) & (F.get(words, i) != ""))

        def chains(at: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda j: (j == 0) | (F.get(at, j) - F.get(at, j - 1) > 1))
            return F.transform(starts, lambda j: _short(F.xxhash64(F.coalesce(F.get(words, F.get(at, j) - 1), F.lit("")), *[F.get(words, F.get(at, j + k)) for k in range(chain)])))

        return _let(content, lambda at: F.when(F.size(at) > 0, chains(at)))

    # Spark evaluates the arrays of both steps once a row
    return F.array_sort(F.array_distinct(F.coalesce(_let(words_of(text), of), F.array(_short(F.xxhash64(F.lit("whole"), text))))))


def _short(h: Column) -> Column:
    return (h.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int")


def as_text(signs: Column) -> Column:
    """The set as a string: eight hex digits a signature, in order."""
    return F.array_join(F.transform(signs, lambda s: F.lpad(F.lower(F.hex(s.cast("long") + F.lit(1 << 31))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both).cast("double")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` (doc_id and ``columns``) with a struct ``nxt`` of the next document's columns, by descending doc_id; after the last comes the first.

    Ids are ordered in spans of at most SPAN values, each sorted on its own.
    What follows a span's last document is the largest id of the next span
    that has one; that document joins the span as a guest.  The list of span
    heads is reduced by the same rule until it is short, so no step orders
    all documents in one place.
    """
    # a null id comes last: below the smallest of all
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    heads = docs.select(key.alias("id")).groupBy(_span("id").alias("span")).agg(F.max("id").alias("head"))
    heads = checkpointed(heads)
    n = heads.count()
    follow = _followers(heads, n)
    guests_of = follow.select(F.col("guest").alias("__id"), F.col("span").alias("__host"))
    if n * 16 <= BROADCAST_BYTES:
        guests_of = F.broadcast(guests_of)  # counted: two numbers a span
    rows = docs.select(key.alias("__key"), *columns, F.col("doc_id"))
    guests = rows.join(guests_of, F.col("__key") == F.col("__id")).drop("__id").withColumn("__guest", F.lit(True))
    own = rows.withColumn("__host", _span("__key")).withColumn("__guest", F.lit(False))
    every = own.unionByName(guests.select(*own.columns))
    order = W.partitionBy("__host").orderBy("__guest", F.col("__key").desc(), *[F.col(c) for c in columns if c == "text"])
    done = every.withColumn("nxt", F.lead(F.struct(*columns)).over(order)).where(~F.col("__guest"))
    return done.drop("__key", "__host", "__guest")


def _span(column: str) -> Column:
    return F.shiftright(F.col(column), int(math.log2(SPAN)))


def _followers(heads: DataFrame, n: int) -> DataFrame:
    """(span, guest): for each span, the largest id of the next lower span that has one; for the lowest, that of the highest."""
    if n <= ONE_TASK:
        # at most ONE_TASK rows: one task may order them
        w = W.partitionBy(F.lit(0)).orderBy(F.col("span").desc())
        whole = W.partitionBy(F.lit(0))
        return heads.select("span", F.coalesce(F.lead("head").over(w), F.max("head").over(whole)).alias("guest"))
    upper = checkpointed(heads.groupBy(_span("span").alias("up")).agg(F.max("span").alias("span"), F.max("head").alias("head")))
    across = _followers(upper.select(F.col("up").alias("span"), "head"), upper.count()).select(F.col("span").alias("up"), F.col("guest").alias("across"))
    w = W.partitionBy("up").orderBy(F.col("span").desc())
    inner = heads.withColumn("up", _span("span")).withColumn("guest", F.lead("head").over(w))
    return inner.join(across, "up").select("span", F.coalesce("guest", "across").alias("guest"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, the edited text's hash, both fingerprints, and the likeness to the edited text and to the next document."""
    prepare(docs.sparkSession)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("signs", signatures(F.col("text")))
    near = with_next(own, ["text", "signs"])
    n = F.char_length("text").cast("long")
    cut = F.floor(n / 3).cast("int")
    near = near.select("doc_id", n.alias("n_chars"), "signs", F.col("nxt.signs").alias("next_signs"), F.concat(F.substring("text", F.lit(1), (n - cut).cast("int")), F.substring("nxt.text", F.lit(1), cut)).alias("edited"))
    near = near.withColumn("edited_signs", signatures(F.col("edited")))
    return near.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("signs")).alias("fingerprint"), as_text(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"), likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )


def similar_pairs(docs: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of texts with equal or alike fingerprints.

    ``members`` has doc_id and class_id, the smallest doc_id with the same
    fingerprint; ``pairs`` has left_id < right_id of classes whose sets have
    at least that Jaccard likeness, and the likeness.
    """
    prepare(docs.sparkSession)
    signed = docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("signs")).withColumn("print", F.sha2(as_text(F.col("signs")), 256))
    signed = checkpointed(signed)
    classes = signed.groupBy("print").agg(F.min("doc_id").alias("class_id"))
    members = signed.select("doc_id", "print").join(classes, "print").select("doc_id", "class_id")
    sets = signed.join(classes.withColumnRenamed("class_id", "doc_id"), ["print", "doc_id"], "left_semi").dropDuplicates(["print"]).select("doc_id", "signs", F.size("signs").alias("n"))
    sets = checkpointed(sets)
    # lengths in ranges: sets in ranges further apart than one cannot reach the threshold
    width = -math.log(threshold)
    ranged = sets.withColumn("range", F.floor(F.log(F.col("n").cast("double")) / width + 1e-9))
    df = sets.select(F.explode("signs").alias("sign")).groupBy("sign").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # of n signatures in the order of rarity, the first n - ceil(t n) + 1 must hold a shared one
    tokens = ranged.select("doc_id", "n", "range", F.explode("signs").alias("sign")).join(df, "sign", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("df", "sign"))
    prefix = tokens.withColumn("place", place).where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) & (F.col("df") > 1))
    left = prefix.select(F.col("doc_id").alias("left_id"), F.col("n").alias("ln"), "sign", F.col("place").alias("lp"), F.explode(F.array(F.col("range"), F.col("range") + 1)).alias("range"))
    right = prefix.select(F.col("doc_id").alias("right_id"), F.col("n").alias("rn"), "sign", F.col("place").alias("rp"), "range")
    found = left.join(right, ["sign", "range"]).where(
        ((F.col("ln") < F.col("rn")) | ((F.col("ln") == F.col("rn")) & (F.col("left_id") < F.col("right_id")))) & (F.col("ln") >= F.col("rn") * threshold - 1e-9)
        # what can still be shared after these places
        & (1 + F.least(F.col("ln") - F.col("lp"), F.col("rn") - F.col("rp")) >= (F.col("ln") + F.col("rn")) * (threshold / (1 + threshold)) - 1e-9)
    )
    found = found.select("left_id", "right_id").distinct()
    a, b = sets.select(F.col("doc_id").alias("left_id"), F.col("signs").alias("a")), sets.select(F.col("doc_id").alias("right_id"), F.col("signs").alias("b"))
    pairs = found.join(a, "left_id").join(b, "right_id").withColumn("likeness", likeness(F.col("a"), F.col("b"))).where(F.col("likeness") >= threshold)
    return members, pairs.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "likeness")

