"""Near-duplicates by HyperMinHash.

A document is the set of its distinct word shingles.  Documents with equal sets are one
node.  Each shingle hash belongs to one of ``BUCKETS`` buckets; a bucket's register keeps
the least of its values in 16 bits: the number of leading zeros and the ``MANTISSA`` bits
behind the leading one.  Empty registers borrow from others (the same for all documents),
so small sets band as large ones do.  Registers are banded, and nodes that share a band
are candidates.

Candidates are resolved in two rounds, without pairing up all members of a band:

1. every member of a band is paired with the band's first member, and with the one before
   it in its part of the band (parts hold about ``PART`` members, by hash, so no task orders a
   large band); a band of n members gives at most 2n pairs;
2. once components are known, only members of a band that still lie in different
   components are compared, in blocks of bounded size: first by the collision-corrected
   estimate, then on full sets, and only links that join two components are passed on.

Pairs of both rounds are confirmed on full sets: an estimate only drops pairs that lie more
than ``DEVIATIONS`` standard deviations below the threshold.  An estimate rests on as many
registers as are not borrowed, at most one per shingle, so its deviation is that of the
smaller set.  A linked pair misses each band with less than one chance in 10,000 and
is dropped by the estimate with about one in 30,000; all else is exact.  Two members of one component need no comparison, as
a link between them would change nothing.  Components are found by alternating
large-star and small-star steps with a checkpoint after each.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  A text with fewer words than a
shingle has them as one shingle; null and empty texts have no set, are linked with nothing
and get their own key as component.  A null key belongs to its set's component but is
never its name; if a component has no other, its name is null.  Repeated rows have one set
and get one row each.  Texts of any length are handled; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratarates.llm import scratch
from stratarates.llm.words import NOT_SPACE, Words, chunks, give_back, mix

BUCKETS, MANTISSA = 256, 10
BAND, BANDS = 7, 36
DEVIATIONS = 4
#: members of a band that are ordered in one group
PART = 4096
#: rows that a worker computes registers or links of at a time
PIECE = 1024
#: shingles of a band's members that a task compares with as many others at a time
BLOCK = 500_000
#: stands for a null key meanwhile
NO_KEY = int(np.iinfo(np.int64).max)
_U = np.uint64


# --- sets and registers ---------------------------------------------------------------

SETS = "doc_id long, tag long, node binary, n long, registers binary, shingles binary"


def _sets_of(w: Words, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    at, h = w.windows(width)
    cut = np.searchsorted(w.doc[at], np.arange(len(w.count) + 1)) if len(at) else np.zeros(len(w.count) + 1, int)
    short = np.flatnonzero((w.count > 0) & (w.count < width))
    whole = dict(zip(short.tolist(), w.whole_hash(short))) if len(short) else {}
    return [np.unique(h[a:b]) if b > a else np.array([whole[d]] if d in whole else [], _U)
            for d, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist()))]


def registers(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(sets, BUCKETS) registers of consecutive sets; 0 stands for an empty set."""
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    bucket = (values & _U(BUCKETS - 1)).astype(np.int64)
    least = np.full(n * BUCKETS, np.iinfo(np.uint64).max, _U)
    np.minimum.at(least, owner * BUCKETS + bucket, values >> _U(8) << _U(8))
    least = least.reshape(n, BUCKETS)
    empty = least == np.iinfo(np.uint64).max
    # leading zeros, and the bits behind the leading one; the exponent of the float is exact
    # up to rounding, which is the same for equal values
    zeros = 63 - np.frexp(np.maximum(least >> _U(11), _U(1)).astype(np.float64))[1] - 10
    zeros = np.clip(zeros, 0, 52)
    behind = (least << (zeros + 1).astype(_U)) >> _U(64 - MANTISSA)
    out = ((zeros.astype(np.uint16) << np.uint16(MANTISSA)) | behind.astype(np.uint16)) + np.uint16(1)
    some = ~empty.all(axis=1)
    out[empty] = 0
    # borrow: the k-th try of a bucket looks at a bucket that depends on both alone
    left = empty & some[:, None]
    attempt = 0
    while left.any():
        attempt += 1
        donor = (mix(np.arange(BUCKETS, dtype=_U) + _U(attempt * 1_000_003)) & _U(BUCKETS - 1)).astype(np.int64)
        rows, cols = np.nonzero(left)
        ok = ~empty[rows, donor[cols]]
        out[rows[ok], cols[ok]] = out[rows[ok], donor[cols[ok]]]
        left[rows[ok], cols[ok]] = False
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, less the matches expected of unrelated sets."""
    same = (a == b).mean(axis=-1)
    ratio = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    by_chance = 0.169919 / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.clip((same - by_chance) / (1 - by_chance), 0, 1)


def least_estimate(threshold: float, n: np.ndarray) -> np.ndarray:
    """What a pair at the threshold is estimated at least; ``n``: sizes of the smaller sets."""
    return threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / np.minimum(n, BUCKETS))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, tag, text) without nulls: the tag tells apart texts of one key."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("doc_id"),
                       F.xxhash64(whole).alias("tag"), whole.alias("text"))


def sets(rows: DataFrame, width: int, full: bool = False, sketch: bool = True) -> DataFrame:
    """(doc_id, tag, node, n, registers, shingles) of ``keyed`` rows: node identifies the set
    and is null for none; registers or, if ``full``, the sorted hashes are filled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, rows=PIECE):
            found = _sets_of(Words(chunk.column("text"), NOT_SPACE, lower=True), width)
            size = np.array([len(s) for s in found])
            node = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in found]
            if full:
                filled = [None] * len(found), [s.tobytes() for s in found]
            elif sketch:
                made = registers(np.concatenate(found), size)
                filled = [row.tobytes() for row in made], [None] * len(found)
            else:
                filled = [None] * len(found), [None] * len(found)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), chunk.column("tag"), pa.array(node, pa.binary()), pa.array(size.astype(np.int64)),
                 pa.array(filled[0], pa.binary()), pa.array(filled[1], pa.binary())],
                names=["doc_id", "tag", "node", "n", "registers", "shingles"])

    return rows.mapInArrow(run, SETS)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Cut batches to ``rows``, since what is computed of registers is many times their size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def bands(nodes: DataFrame) -> DataFrame:
    """(band, number, node): a 64-bit value per band of a node's registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = mix(np.arange(1, BAND + 1, dtype=_U)) | _U(1)
        for batch in pieces(batches):
            raw = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16)
            part = raw.reshape(-1, BUCKETS)[:, :BAND * BANDS].reshape(-1, BANDS, BAND).astype(_U)
            value = mix(mix((mix(part) * weight).sum(axis=2)) + np.arange(BANDS, dtype=_U))
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.ravel().view(np.int64)),
                 pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(part))),
                 batch.column("node").take(pa.array(np.repeat(np.arange(len(part)), BANDS)))],
                names=["band", "number", "node"])

    return nodes.select("node", "registers").mapInArrow(run, "band long, number int, node binary")


# --- links ----------------------------------------------------------------------------

def _pairs(rows: DataFrame) -> DataFrame:
    return rows.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shared_bands(of: DataFrame) -> DataFrame:
    """(band, number, node, first, members) of bands with several members: the members are
    counted and the first is found map-side, and joined back with a join that AQE may split."""
    kinds = of.groupBy("band").agg(F.count("*").alias("members"), F.min("node").alias("first")).where("members > 1")
    return of.join(kinds, "band").select("band", "number", "node", "first", "members")


def star_pairs(shared: DataFrame) -> DataFrame:
    """Each member of a band with the band's first and with its predecessor in its part."""
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / F.lit(PART)).cast("long")).cast("int")
    order = Window.partitionBy("band", "part").orderBy("node")
    rows = shared.withColumn("part", part).select(
        F.col("node").alias("b"), "first", F.lag("node").over(order).alias("before"))
    return _pairs(rows.select("b", F.explode(F.array("first", "before")).alias("a")))


def near_threshold(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs whose sizes allow the threshold and whose estimate comes near it."""
    side = nodes.select("node", "n", "registers")
    both = (pairs.join(side.toDF("a", "n_a", "r_a"), "a").join(side.toDF("b", "n_b", "r_b"), "b")
            .where(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS)
                    for c in ("r_a", "r_b"))
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            keep = estimate(a, b, n_a, n_b) >= least_estimate(least, np.minimum(n_a, n_b))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a binary, b binary")


def confirmed(pairs: DataFrame, full: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs with ``threshold[1] * |intersection| >= threshold[0] * |union|``."""
    part, whole = threshold
    both = pairs.join(full.toDF("a", "s_a"), "a").join(full.toDF("b", "s_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keep = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b")):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(whole * common >= part * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of linked nodes; the label is the component's least node."""
    spark = links.sparkSession
    scratch.checkpoints(spark)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("u").agg(F.min("v").alias("m"))

    while True:
        # large star: every greater neighbour goes to the least of u's neighbourhood
        both = edges.union(edges.select("v", "u"))
        m = least(both.union(edges.select(F.col("u"), F.col("u"))).union(edges.select("v", "v")))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its lesser neighbours go to the least of them
        m = least(large)
        rows = large.join(m, "u")
        small = rows.select(F.col("v").alias("u"), F.col("m").alias("v")).union(rows.select("u", F.col("m")))
        small = small.where("u != v").distinct().checkpoint()
        if not small.exceptAll(edges).take(1) and not edges.exceptAll(small).take(1):
            break
        edges = small
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        edges.select("v", "v")).distinct()


def _blocks(shingles: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(shingles / F.lit(BLOCK))).cast("int")


def cross_links(shared: DataFrame, nodes: DataFrame, full: DataFrame, labels: DataFrame,
                threshold: tuple[int, int]) -> DataFrame:
    """Links between band members of different components, enough to join what they join.

    Every member is a resident of one block of its band; members outside the band's
    commonest component are visitors, in blocks too.  A task compares one block of
    residents with one block of visitors, so it holds at most about 2 * BLOCK shingles (or
    two longer sets).  Pairs are looked at in the first band they share, and only as long
    as nothing found in the block connects them already, so a block gives fewer links than
    it has members.
    """
    rows = shared.join(labels, "node", "left").join(nodes.select("node", "n"), "node").select(
        "band", "number", "node", "n", F.coalesce("label", "node").alias("label"))
    kinds = rows.groupBy("band", "label").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    mixed = (kinds.groupBy("band")
             .agg(F.sum("k").alias("members"), F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"),
                  F.count("*").alias("kinds"))
             .where("kinds > 1 and members > 3")  # up to three, round one has paired all
             .select("band", F.col("most.label").alias("most"), _blocks(F.col("n")).alias("homes"),
                     _blocks(F.col("n") - F.col("most.n")).alias("tours")))
    rows = rows.drop("n").join(mixed, "band").join(full, "node")
    place = F.abs(F.xxhash64("node") % 1_000_003)
    columns = ["band", "number", "node", "label", "shingles"]
    home = rows.select(*columns, F.lit(False).alias("visitor"), (place % F.col("homes")).cast("int").alias("home"),
                       F.explode(F.sequence(F.lit(0), F.col("tours") - 1)).alias("tour"))
    tour = rows.where("label != most").select(
        *columns, F.lit(True).alias("visitor"), F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("home"),
        (F.floor(place / 7) % F.col("tours")).cast("int").alias("tour"))
    part, whole = threshold
    least = part / whole

    def run(table: pa.Table) -> pa.Table:
        visitor = table.column("visitor").to_numpy()
        number = table.column("number")[0].as_py()
        node = table.column("node").to_pylist()
        group = np.unique(table.column("label").to_pylist(), return_inverse=True)[1]
        found = [np.frombuffer(s, _U) for s in table.column("shingles").to_pylist()]
        n = np.array([len(s) for s in found])
        sketch = registers(np.concatenate(found), n)
        before = sketch[:, :BAND * number]
        here = np.flatnonzero(~visitor)
        a, b = [], []
        for v in np.flatnonzero(visitor).tolist():
            other = here[(group[here] != group[v]) & (np.minimum(n[here], n[v]) >= least * np.maximum(n[here], n[v]))]
            bound = least_estimate(least, np.minimum(n[other], n[v]))
            other = other[estimate(sketch[other], sketch[v], n[other], n[v]) >= bound]
            if number and len(other):
                earlier = (before[other] == before[v]).reshape(len(other), number, BAND).all(axis=2).any(axis=1)
                other = other[~earlier]
            for i in other.tolist():
                if group[i] == group[v]:
                    continue
                common = len(np.intersect1d(found[i], found[v], assume_unique=True))
                if whole * common >= part * (n[i] + n[v] - common):
                    group[group == group[i]] = group[v]
                    a.append(node[v])
                    b.append(node[i])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return home.unionByName(tour).groupBy("band", "home", "tour").applyInArrow(run, "a binary, b binary")


def labelled(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100),
             key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``."""
    rows = keyed(docs, key, text)
    return _named(sets(rows, width, sketch=False).select("doc_id", "node", "n"), _labels(rows, width, threshold))


def _labels(rows: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """(node, label) of the linked nodes of ``keyed`` rows."""
    least = threshold[0] / threshold[1]

    nodes = scratch.stage(
        sets(rows, width).where("node is not null").groupBy("node")
        .agg(F.first("n").alias("n"), F.first("registers").alias("registers"),
             F.min(F.struct("doc_id", "tag")).alias("text_of")), "near-nodes")
    shared = scratch.stage(shared_bands(bands(nodes)), "near-bands")
    candidates = shared.select("node").distinct()
    sketched = scratch.stage(nodes.join(candidates, "node", "left_semi"), "near-sketches")
    full = scratch.stage(_full_sets(rows, sketched, width), "near-sets")

    first = scratch.stage(near_threshold(star_pairs(shared), sketched, least), "near-pairs")
    links = scratch.stage(confirmed(first, full, threshold), "near-links")
    labels = components(links)
    more = scratch.stage(cross_links(shared, sketched, full, labels, threshold), "near-links")
    if more.take(1):
        labels = components(labels.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))
                            .union(_between(more, labels)))
    return labels


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links as links between the labels of their ends."""
    for end in ("a", "b"):
        links = links.join(labels.toDF(end, "label_of"), end, "left").withColumn(
            end, F.coalesce("label_of", end)).drop("label_of")
    return links.select("a", "b").where("a != b")


def _full_sets(rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of ``nodes``, each from one of its texts."""
    wanted = nodes.select("text_of.doc_id", "text_of.tag")
    # by shuffle at every size, so that memory and disk grow with the input alone
    texts = rows.join(wanted.hint("merge"), ["doc_id", "tag"], "left_semi")
    return sets(texts, width, full=True).groupBy("node").agg(F.first("shingles").alias("shingles"))


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Components bear the least key of their documents."""
    rows = rows.withColumn("doc_id", F.when(F.col("doc_id") != NO_KEY, F.col("doc_id")))
    of = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = of.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("name"))
    return of.join(names, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("name")).alias("component_id"))


def representatives(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100),
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that of the least key and then text hash, null keys last; all
    columns stay.  Rows are told apart by key and text, so other texts of a key stay.  Of rows
    that repeat key and text one stays; without a set, of those that repeat all columns."""
    rows = keyed(docs, key, text)
    labels = _labels(rows, width, threshold)
    found = scratch.stage(
        sets(rows, width, sketch=False).select("doc_id", "tag", "node").join(labels, "node", "left")
        .select("doc_id", "tag", F.coalesce("label", "node").alias("label"))
        .groupBy("doc_id", "tag").agg(F.first("label").alias("label"), F.count("*").alias("times")), "near-rows")
    first = found.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "tag")).alias("first"))
    judged = found.join(first, "label", "left").select(
        F.col("doc_id").alias("__key"), F.col("tag").alias("__tag"), F.col("label").isNull().alias("__bare"), "times",
        (F.col("label").isNotNull() & (F.struct("doc_id", "tag") != F.col("first"))).alias("gone"))
    apart = docs.withColumns({"__key": F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)),
                              "__tag": F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))})
    # the texts are shuffled once, at every size; both branches below read the same join
    both = apart.join(judged.where("gone or times > 1").hint("merge"), ["__key", "__tag"], "left").where(
        "NOT coalesce(gone, false)")
    once = both.where("times IS NULL")
    same = F.when(F.col("__bare"), F.xxhash64(F.to_json(F.struct(*docs.columns))))
    repeated = both.where("times IS NOT NULL").withColumn("__same", same).dropDuplicates(["__key", "__tag", "__same"])
    return once.select(*docs.columns).unionByName(repeated.select(*docs.columns))
