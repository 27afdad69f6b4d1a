"""Shards by vector bin packing.

The rows of equal texts are a group with a vector of bytes, tokens and rows, each as a share
of the total.  A shard's capacity is an equal share of all three.  Groups are placed from the
largest to the smallest, each in the shard whose residual capacity has the highest dot product
with the group's vector; shards in which the group fits in all three come first, then those
in which its bytes fit.  Where it fits nowhere, only the bytes left count.

Placing is greedy and hence one after another, so it is cut up without giving up balance:

* a group that would fill more than a shard is split by row into parts of about a quarter of a shard
  (at most ``3 * shards`` groups can be so large);
* groups and parts above ``1 / FINE`` of a shard are placed first, all together: there are at
  most about ``3 * shards * FINE`` of them, whatever the size of the table;
* smaller groups are dealt by size class (powers of two) and hash into slices of about
  ``SLICE`` groups.  Every slice is packed by a task of its own into what the large groups
  left of each shard, in the proportion of its own total.  Groups of a slice are alike in size,
  so a slice is out of balance by about one of its groups, and slices begin at different shards.

The law is ``bytes``: shards are near equal in bytes, and so are tokens and rows as far as the
texts allow.  Equal texts share a shard unless their group is split.

A null text has no bytes, no tokens and a checksum of 0, and forms a group of its own.  Null
and repeated keys are rows like others.  Numbers within a shard (``slot``) follow the written
files, so no task sorts a shard.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratarates.llm import scratch
from stratarates.sources.places import with_places

SHARDS = 16
FINE = 1024
SLICE = 4096
WORD = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("bytes", "tokens", "rows")


def place(vectors: np.ndarray, room: np.ndarray, start: int = 0) -> np.ndarray:
    """The shard of each vector.  ``room``: (shards, dimensions), what each shard may take;
    it is lessened by what is placed.  Ties go to the first shard from ``start`` on."""
    shards = len(room)
    turn = (np.arange(shards) + start) % shards
    left = room[turn]
    out = np.empty(len(vectors), np.int32)
    for i in np.argsort(-vectors.max(axis=1), kind="stable").tolist():
        group = vectors[i]
        score = left @ group
        fits = left >= group
        if (every := fits.all(axis=1)).any():
            score[~every] = -np.inf
        elif (law := fits[:, 0]).any():
            score[~law] = -np.inf
        else:
            score = left[:, 0]
        at = int(score.argmax())
        left[at] -= group
        out[i] = turn[at]
    room[turn] = left
    return out


def _sums() -> list[Column]:
    return [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]


def _columns(table: pa.Table) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy().astype(np.float64) for c in DIMENSIONS])


def pack(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text",
         tokens: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, tokens, shard, slot) of each row.  ``tokens`` counts the
    tokens of a text; without it, words do."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = scratch.stage(docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.coalesce(F.regexp_count(whole, F.lit(WORD)) if tokens is None else tokens, F.lit(0))
        .cast("long").alias("tokens"),
        F.xxhash64(text).alias("group")), "shard-rows")
    groups = scratch.stage(rows.groupBy("group").agg(*_sums()), "shard-groups")
    found = groups.agg(*[F.sum(c).alias(c) for c in DIMENSIONS]).first()
    total = np.array([float(found[c] or 1) for c in DIMENSIONS])
    share = F.greatest(*[F.col(c) / F.lit(float(t)) for c, t in zip(DIMENSIONS, total)])
    sized = groups.withColumn("share", share)

    # split what is larger than a shard; at most 3 * shards groups
    split = sized.where(F.col("share") > 1 / shards).select(
        "group", F.ceil(4 * shards * F.col("share")).cast("int").alias("parts"))
    at = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    apart = rows.withColumn("at", at).join(F.broadcast(split), "group", "left").withColumn(
        "part", F.coalesce(F.pmod("at", "parts"), F.lit(0)).cast("int"))
    parts = apart.where("parts IS NOT NULL").groupBy("group", "part").agg(*_sums())
    large = sized.where((F.col("share") <= 1 / shards) & (F.col("share") > 1 / (shards * FINE)))
    large = large.select("group", F.lit(0).alias("part"), *DIMENSIONS).unionByName(parts)

    # at most about 3 * shards * FINE rows
    first = large.orderBy("group", "part").toArrow()
    room = np.full((shards, len(DIMENSIONS)), 1 / shards)
    taken = place(_columns(first) / total, room)
    placed = docs.sparkSession.createDataFrame(pa.table({
        "group": first.column("group").combine_chunks().cast(pa.int64()),
        "part": first.column("part").combine_chunks().cast(pa.int32()), "shard": pa.array(taken, pa.int32())}))

    # what large groups left, as a share of each shard
    left = np.maximum(room, 0)
    left = np.where(left.sum(axis=0) > 0, left / np.maximum(left.sum(axis=0), 1e-300), 1 / shards)
    small = sized.where(F.col("share") <= 1 / (shards * FINE)).withColumn(
        "kind", F.floor(-F.log2("share")).cast("int"))
    counts = {r["kind"]: r["n"] for r in small.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # some 60 at most
    slices = [-(-counts.get(k, 1) // SLICE) for k in range(max(counts, default=0) + 1)]
    number = F.pmod(F.xxhash64("group"), F.element_at(F.array(*map(F.lit, slices)), F.col("kind") + 1)).cast("int")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("group")
        vectors = _columns(table) / total
        start = table.column("slice")[0].as_py() + table.column("kind")[0].as_py()
        own = place(vectors, left * vectors.sum(axis=0), start)
        return pa.table({"member": table.column("group"), "shard_of": pa.array(own, pa.int32())})

    others = small.withColumn("slice", number).groupBy("kind", "slice").applyInArrow(run, "member long, shard_of int")

    # rows of large groups find no small group: they bear their own hash, so none is hot
    known = apart.join(F.broadcast(placed), ["group", "part"], "left")
    link = F.when(F.col("shard").isNull(), F.col("group")).otherwise(F.col("at"))
    both = known.withColumn("link", link).join(others, F.col("link") == F.col("member"), "left").select(
        "doc_id", "size", "text_crc32", "tokens", F.coalesce("shard", "shard_of").alias("shard"))
    dealt = scratch.stage(both.sortWithinPartitions("shard", "doc_id", "text_crc32"), "shard-dealt")
    return with_places(dealt, ["shard"], "slot").select("doc_id", "size", "text_crc32", "tokens", "shard", "slot")
