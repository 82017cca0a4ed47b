"""Chat formatting with cumulative-snapshot collapse.

Loggers often store a conversation again after each turn.  A rolling hash
over a conversation's turns names each of its prefixes; a conversation whose
whole hash is a proper prefix of a longer one is a snapshot and goes.  Of
equal conversations the smallest conv_id stays.  What is left is rendered.

All steps are DataFrame functions.  A prefix's hash is the exclusive or of
128-bit hashes of its turns with their numbers, so it rolls on from turn to
turn as a running aggregate, linear in a conversation's length.  Prefix hashes
are reduced to distinct values before they meet the conversations, so a first
turn that a third of all conversations share is one row.

Defined cases: turns are ordered by turn, then role and text (nulls first);
repeated rows count once; a null role or text is empty; a null turn comes
first; rows without conv_id are one conversation; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, prepare

NAME = ["n", "a", "b"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, role and text of each turn; its number n; a and b, the hash of the turns up to it; and whether it is the last."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # one exchange serves the distinct rows and the windows
    turns = turns.repartition("conv_id").distinct()
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    own = lambda seed: F.xxhash64(F.lit(seed), "n", F.char_length("role"), "role", "text")
    numbered = turns.withColumn("n", F.row_number().over(order)).withColumn("last", F.lead(F.lit(True)).over(order).isNull())
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return numbered.select("conv_id", "role", "text", "n", "last", *[F.bit_xor(own(k)).over(so_far).alias(name) for k, name in enumerate(NAME[1:])])


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (role, text) of the conversations that no longer one begins with; of equal ones the smallest conv_id."""
    prepare(conversations.sparkSession)
    each = checkpointed(turns_of(conversations))
    whole = each.where("last").groupBy(*NAME).agg(F.min("conv_id").alias("conv_id"))
    inner = each.where("not last").select(*NAME).distinct()
    kept = whole.join(inner, NAME, "left_anti").select(F.col("conv_id").alias("kept"))
    held = each.join(kept, F.col("conv_id").eqNullSafe(F.col("kept")), "left_semi")
    turns = held.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "role", "text"))).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render(turns: Column) -> Column:
    """The chat text: for each turn its role between marks, and the text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "")


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and the rendered text of every maximal conversation."""
    return maximal(conversations).select("conv_id", F.size("turns").cast("long").alias("n_turns"), render(F.col("turns")).alias("rendered"))
