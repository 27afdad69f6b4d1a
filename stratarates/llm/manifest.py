"""Merkle manifest of a table: one digest for all rows, and a proof for each.

H is the lowercase hexadecimal SHA-256 of its inputs, joined.  A row is a leaf: H of its key,
source, language, length and text, each ``-`` if null, else its number of UTF-8 bytes, ``:`` and
the value.  The leaves of a language (a tree) ascend by key, nulls first and ties by leaf.
While a tree has several nodes, every ``FAN`` consecutive ones (the last run may be shorter, even
a single one) become one, their H.  What remains is the tree's subroot; the subroots, ordered
by language (null first, then by UTF-8 bytes), are combined likewise into the root.

Digests are resumed, not recomputed: hashing a run, its parent keeps a copy of the hash state
before each child's slot.  Replacing a child resumes the state of its slot with the new digest
and the siblings to its right; what stands left of it is never hashed again.  The leaf, too,
keeps its state before the text, for a changed text.

Trees are cut into blocks of 4,096 consecutive nodes, so a language that holds most
of the rows is many blocks.  On the way up a task hashes one block to its top node; the tops
are cut into blocks again until one node remains.  On the way down every block gets the path of
its top (the siblings left and right of it, level by level up to the root), and a task folds
all rows of a block: within the block by the states of its parents, above it by states
resumed once per block behind the left siblings.

Nulls are written as ``-``.  Repeated rows are leaves of their own with equal digests.  Texts of
any length are hashed whole.  A null key is never tampered with.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from stratarates.llm import scratch
from stratarates.llm.words import chunks
from stratarates.sources.places import with_places

FAN = 8
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value: bytes | None) -> bytes:
    return b"-" if value is None else b"%d:%s" % (len(value), value)


class Run:
    """A parent of up to ``FAN`` children, with its hash state before each child's slot."""

    def __init__(self, children: list[str]):
        self.children = children
        state = hashlib.sha256()
        self.before = []
        for child in children:
            self.before.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()
        self.right = ["".join(children[i + 1:]).encode() for i in range(len(children))]

    def siblings(self, slot: int) -> str:
        return "".join(self.children[:slot] + self.children[slot + 1:])

    def folded(self, slot: int, replacement: str) -> str:
        state = self.before[slot].copy()
        state.update(replacement.encode())
        state.update(self.right[slot])
        return state.hexdigest()


def grown(nodes: list[str], levels: int) -> list[list[Run]]:
    """The runs of ``levels`` levels above ``nodes``; the last level has one run if the nodes
    are a block."""
    out = []
    for _ in range(levels):
        out.append([Run(nodes[i:i + FAN]) for i in range(0, len(nodes), FAN)])
        nodes = [run.digest for run in out[-1]]
    return out


def heights(nodes: int) -> int:
    """Levels above a tree's nodes."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tampered: bool = False) -> DataFrame:
    """(doc_id, tree, leaf, changed): ``changed`` is the leaf of the text with A-Z lower-cased where 3
    divides the checksum of the key, if ``tampered`` and if that makes a difference.  ``tree``
    sorts as languages do, null first."""
    key, source, lang, count, text = fields
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit("")).alias("tree"),
        *[F.col(c).cast("string").alias(n) for c, n in ((source, "source"), (lang, "lang"), (count, "n_chars"))],
        F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            ids = chunk.column("doc_id").to_pylist()
            head = zip(ids, *(chunk.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
            texts = chunk.column("text").cast(pa.large_binary())
            leaf, changed = [], []
            for (doc, *rest), text in zip(head, texts):
                name = None if doc is None else str(doc).encode()
                state = hashlib.sha256(_field(name))
                for value in rest:
                    state.update(_field(None if value is None else value.encode()))
                body = None if (b := text.as_buffer()) is None else b.to_pybytes()
                before = state.copy()
                state.update(_field(body))
                leaf.append(state.hexdigest())
                other = None
                if tampered and body is not None and name is not None and zlib.crc32(name) % 3 == 0:
                    lower = body.lower()  # of bytes: A-Z alone
                    if lower != body:
                        before.update(_field(lower))
                        other = before.hexdigest()
                changed.append(other)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), chunk.column("tree"), pa.array(leaf, pa.string()),
                 pa.array(changed, pa.string())], names=["doc_id", "tree", "leaf", "changed"])

    return rows.mapInArrow(run, "doc_id long, tree string, leaf string, changed string")


def _blocks(nodes: DataFrame, most: int) -> GroupedData:
    block = F.floor(F.col("place") / F.lit(FAN ** most)).cast("long")
    return nodes.withColumn("block", block).groupBy("tree", "block")


def _tops(nodes: DataFrame, most: int) -> DataFrame:
    """(tree, place, node, size): each block's top as a node of the next round."""
    width = FAN ** most

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        size = table.column("size")[0].as_py()
        levels = min(most, heights(size))
        found = table.column("node").to_pylist()
        top = grown(found, levels)[-1][0].digest if levels else found[0]
        return pa.table({"tree": table.column("tree").slice(0, 1), "place": [table.column("place")[0].as_py() // width],
                         "node": [top], "size": [-(-size // width)]})

    return scratch.stage(_blocks(nodes.select("tree", "place", "node", "size"), most).applyInArrow(
        run, "tree string, place long, node string, size long"), "manifest-tops")


def _rounds(nodes: DataFrame, most: int) -> list[DataFrame]:
    """``nodes`` and the rounds above, up to that with one node per tree."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("size")).first()[0] or 0) > 1:
        rounds.append(_tops(rounds[-1], most))
    return rounds


PATH = "path array<struct<left:string,right:string>>"


def _paths(nodes: DataFrame, above: DataFrame, most: int) -> DataFrame:
    """(tree, place, path) of each node, from ``above``: (tree, place, path) of the blocks' tops."""

    def run(table: pa.Table, top: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        n = table.num_rows
        levels = min(most, heights(table.column("size")[0].as_py()))
        runs = grown(table.column("node").to_pylist(), levels)
        rest = top.column("path")[0].as_py()
        paths = []
        for i in range(n):
            own, at = [], i
            for level in runs:
                run, slot = level[at // FAN], at % FAN
                own.append({"left": "".join(run.children[:slot]), "right": "".join(run.children[slot + 1:])})
                at //= FAN
            paths.append(own + rest)
        return pa.table({"tree": table.column("tree"), "place": table.column("place"), "path": pa.array(
            paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))})

    tops = above.withColumnRenamed("place", "block").groupBy("tree", "block")
    return (_blocks(nodes.select("tree", "place", "node", "size"), most).cogroup(tops)
            .applyInArrow(run, f"tree string, place long, {PATH}"))


def _downward(rounds: list[DataFrame], path: DataFrame, most: int) -> DataFrame:
    """The paths of the first of ``rounds``, from those of the single nodes above the last."""
    for nodes in reversed(rounds):
        path = scratch.stage(_paths(nodes, path, most), "manifest-paths")
    return path


RESULT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tampered: bool = False,
             most: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    ``folded_root`` is the root that the row's own leaf, or its ``changed`` one, gives with the
    siblings of its proof; ``verified`` says that it is the root.  A block has ``FAN ** most`` nodes."""
    # staged first, since a sort by ranges reads its input twice
    hashed = scratch.stage(leaves(docs, fields, tampered), "manifest-hashes")
    rows = hashed.withColumn("at", F.xxhash64("_metadata.file_name", "_metadata.row_index"))
    ordered = scratch.stage(rows.orderBy("tree", F.col("doc_id").asc_nulls_first(), "leaf", "at").drop("at"),
                            "manifest-leaves")
    placed = with_places(ordered, ["tree"], "place", "size")
    nodes = placed.select("tree", "place", F.col("leaf").alias("node"), "size")
    rounds = _rounds(nodes, most)
    subroots = rounds[-1].select("tree", F.col("node").alias("subroot"))

    # the trees' subroots are the nodes of one more tree
    whole = scratch.stage(subroots.orderBy("tree").select(F.lit("").alias("tree"), "subroot", F.col("tree").alias("of")),
                          "manifest-subroots")
    heads = with_places(whole, ["tree"], "place", "size").withColumnRenamed("subroot", "node")
    upper = _rounds(heads, most)
    found = upper[-1].select("node").first()
    if found is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    root = found["node"]
    empty = F.expr("CAST(array() AS array<struct<left:string,right:string>>)").alias("path")
    ends = upper[-1].select("tree", "place", empty)
    of_heads = _downward(upper[:-1], ends, most)
    paths = heads.join(of_heads, ["tree", "place"]).select(
        F.col("of").alias("tree"), F.lit(0).cast("long").alias("place"), "path")
    above = _downward(rounds[1:-1], paths, most)
    blocks = above.withColumnRenamed("place", "block").join(subroots, "tree")

    def run(table: pa.Table, top: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        leaf, changed = table.column("leaf").to_pylist(), table.column("changed").to_pylist()
        levels = min(most, heights(table.column("size")[0].as_py()))
        runs = grown(leaf, levels)
        # above the block: the state behind the left siblings, and the right siblings
        path = [(hashlib.sha256(s["left"].encode()), s["right"].encode()) for s in top.column("path")[0].as_py()]
        tail = "".join(s["left"] + s["right"] for s in top.column("path")[0].as_py())
        proofs, folds = [], []
        for i in range(len(leaf)):
            at, node, proof = i, changed[i] or leaf[i], []
            for level in runs:
                run, slot = level[at // FAN], at % FAN
                proof.append(run.siblings(slot))
                node = run.folded(slot, node)
                at //= FAN
            for state, right in path:
                state = state.copy()
                state.update(node.encode())
                state.update(right)
                node = state.hexdigest()
            proofs.append(digest(*proof, tail))
            folds.append(node)
        n = len(leaf)
        return pa.table({
            "doc_id": table.column("doc_id"), "leaf": table.column("leaf"),
            "subroot": [top.column("subroot")[0].as_py()] * n, "root": [root] * n, "proof_sha256": proofs,
            "folded_root": folds, "verified": [f == root for f in folds]})

    return _blocks(placed, most).cogroup(blocks.groupBy("tree", "block")).applyInArrow(run, RESULT)
