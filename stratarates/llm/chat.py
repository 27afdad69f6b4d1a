"""Collapse of conversations that were logged cumulatively, and their rendering.

A log may hold a conversation several times, as it grew.  Each turn gets the hash of all
turns up to it: the running exclusive-or of two 64-bit hashes of (place, role, text).  A
conversation whose last turn's hash is that of an inner turn of another one is a prefix of
it and is dropped; of equal conversations the one with the smallest id stays.  Only what
stays is rendered, as ``<|role|>`` lines followed by the text.

Only built-in expressions are used.  Equal conversations and equal prefixes are reduced to
one row by aggregation (map-side combined) before the anti-join, so a first turn that a
third of all conversations share is one row there.

Turns are ordered by (turn, role, text), nulls first; a repeated turn number keeps both.  A
null role is rendered as ``user``, a null text as empty, and each differs from the string
it is rendered as.  Each row with a null id is a conversation of its own, of one turn, so such rows
are never gathered; equal ones are one, with their number in ``copies``.  Turns of any length
and other columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _turns(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    order = Window.partitionBy("conv_id", "alone").orderBy("turn", "role", "text")
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.select(F.col(key).alias("conv_id"), F.col(turn).alias("turn"),
                      F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    out = out.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    out = out.withColumn("place", F.row_number().over(order))
    said = [F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    return (out.withColumn("h1", F.xxhash64(F.lit(1), *said)).withColumn("h2", F.xxhash64(F.lit(2), *said))
            .withColumn("a", F.bit_xor("h1").over(sofar)).withColumn("b", F.bit_xor("h2").over(sofar))
            .withColumn("last", F.lead("place").over(order).isNull())
            .drop("h1", "h2", "alone"))


def maximal(turns: DataFrame) -> DataFrame:
    """The ids of conversations that are no prefix of another, their number of turns and hashes."""
    ends = (turns.where("last").groupBy("place", "a", "b")
            .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")))
    inner = turns.where("NOT last").select("place", "a", "b").distinct()
    return ends.join(inner, ["place", "a", "b"], "left_anti").select(
        "conv_id", F.col("place").cast("long").alias("n_turns"), "copies", "a", "b")


def render(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """(conv_id, n_turns, copies, text) of every maximal conversation."""
    turns = _turns(rows, key, turn, role, text)
    kept = maximal(turns).withColumnRenamed("conv_id", "id")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.coalesce("text", F.lit("")))
    said = turns.select("conv_id", "place", line.alias("line")).join(kept.drop("a", "b"), F.col("conv_id") == F.col("id"))
    named = said.groupBy("conv_id", "n_turns", "copies").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda s: s["line"]), "\n")
        .alias("text"))
    # turns without an id: equal ones have equal hashes and one text
    alone = turns.where("conv_id IS NULL").groupBy("a", "b").agg(F.first(line).alias("text"))
    single = kept.where("id IS NULL").join(alone, ["a", "b"]).select(F.col("id").alias("conv_id"), "n_turns", "copies", "text")
    return named.unionByName(single)
