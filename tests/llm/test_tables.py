"""Sharding, whitening and the manifest against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratarates.llm import manifest, packing, singular, whitening

# --- sharding ---------------------------------------------------------------------------


def greedy(vectors, room, start):
    """Highest dot product with what is left, in plain loops."""
    left = [list(r) for r in room]
    turn = [(s + start) % len(room) for s in range(len(room))]
    out = [None] * len(vectors)
    for i in sorted(range(len(vectors)), key=lambda i: (-max(vectors[i]), i)):
        fits = [s for s in turn if all(a >= b for a, b in zip(left[s], vectors[i]))]
        fits = fits or [s for s in turn if left[s][0] >= vectors[i][0]]
        best = max(fits or turn, key=lambda s: sum(a * b for a, b in zip(left[s], vectors[i])) if fits else left[s][0])
        left[best] = [a - b for a, b in zip(left[best], vectors[i])]
        out[i] = best
    return out


def test_placing_is_the_greedy_of_the_dot_product():
    rng = np.random.default_rng(5)
    for start in (0, 3, 11):
        vectors = rng.integers(1, 200, (300, 3)) / 4096
        room = np.full((7, 3), vectors.sum() / 21)
        assert packing.place(vectors, room.copy(), start).tolist() == greedy(vectors.tolist(), room.tolist(), start)


def by_shard(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return slots


def test_shards_of_odd_rows(spark, documents, no_documents):
    rows = packing.pack(documents, shards=3).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in documents.collect())
    by_shard(rows)
    texts = {r["doc_id"]: r["text"] for r in documents.where("doc_id IS NOT NULL").collect()}
    for r in rows:
        if r["doc_id"] is not None:
            raw = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert packing.pack(no_documents).count() == 0


def test_shards_are_even_and_copies_stay_together(spark):
    text = F.concat(F.lit("text "), F.col("id"), F.repeat(F.lit(" word"), (F.xxhash64("id") % 97 + 97).cast("int")))
    hot = F.when(F.col("id") % 3 == 0, F.lit("one text that a third of all rows has")).otherwise(
        F.when(F.col("id") % 10 == 1, F.lit("another text")).otherwise(text))
    docs = spark.range(40_000).select(F.lit(7).alias("doc_id"), hot.alias("text"))
    rows = packing.pack(docs, shards=8, tokens=F.length("text")).collect()
    slots = by_shard(rows)
    size, of = Counter(), defaultdict(set)
    for r in rows:
        size[r["shard"]] += r["size"]
        of[(r["text_crc32"], r["size"])].add(r["shard"])
    assert len(slots) == 8
    assert max(size.values()) < 1.01 * min(size.values())
    # a text with half a shard's rows stays whole, so rows are only near even
    assert max(map(len, slots.values())) < 1.5 * min(map(len, slots.values()))
    split = [k for k, v in of.items() if len(v) > 1]
    assert len(split) <= 2  # only texts with more rows than a shard's share


# --- whitening ---------------------------------------------------------------------------


@pytest.mark.parametrize("make", [
    lambda r: np.triu(r.standard_normal((40, 40))),
    lambda r: r.standard_normal((40, 40)) * 2.0 ** -np.arange(40),
    lambda r: np.linalg.qr(r.standard_normal((30, 30)))[0] * np.repeat([5, 3, 1], 10),
    lambda r: np.eye(6) * 3, lambda r: np.zeros((4, 4)), lambda r: np.ones((6, 6)), lambda r: np.array([[2.0]]),
    lambda r: np.diag(np.abs(np.arange(-10, 11)) + 0.5) + np.diag(np.full(20, 0.3), 1),
    lambda r: np.diag(np.repeat([5, 3, 1, .5], 8) * (1 + 1e-12 * r.random(32))) @ np.linalg.qr(r.standard_normal((32, 32)))[0],
])
def test_singular_values_and_directions(make):
    m = make(np.random.default_rng(1)).astype(float)
    e, v = singular.right_vectors(m)
    want = np.linalg.svd(m, compute_uv=False) ** 2
    scale = max(want[0], 1e-300)
    assert np.abs(e - want).max() <= 1e-13 * scale
    kept = e > 0
    v, e = v[:, kept], e[kept]
    assert np.abs(v.T @ v - np.eye(len(e))).max(initial=0) < 1e-11
    assert np.abs(m.T @ (m @ v) - v * e).max(initial=0) < 1e-12 * scale


def test_small_values_keep_their_digits():
    a, b = 10.0 ** -np.arange(12), 0.3 * 10.0 ** -np.arange(11)
    e = singular.squares(a, b)
    # the product of all values is the determinant
    assert math.isclose(float(np.sum(np.log(e))), float(np.sum(np.log(a ** 2))), rel_tol=1e-13)
    assert (np.diff(e) < 0).all()


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string, v int")


def test_whitening_matches_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    c = (rng.standard_normal((700, 40)) @ rng.standard_normal((40, 40))).astype(np.float32)
    odd = [(None, c[0].tolist(), None, 1), (1, c[1].tolist(), "x", 1), (1, c[1].tolist(), "x", 1)]
    bad = [(-1, None, None, 1), (-2, [], None, 1), (-3, [None] + c[2, 1:].tolist(), None, 1),
           (-4, [float("nan")] + c[2, 1:].tolist(), None, 1), (-5, [float("inf")] + c[2, 1:].tolist(), None, 1),
           (-6, [1.0, 2.0], None, 1)]
    rows = [(i, r.tolist(), None, 1) for i, r in enumerate(c) if i > 1] + odd
    found = whitening.whiten(vectors_of(spark, rows + bad).repartition(5)).collect()
    x = np.floor(64 * np.array([r[1] for r in rows], float)) + 1_000_000
    n = len(x)
    s = [sum(int(v) for v in col) for col in x.T]
    centred = x - x.mean(axis=0)
    e, vec = np.linalg.eigh(centred.T @ centred / n)
    e, vec = e[::-1], vec[:, ::-1]
    assert len(found) == n * 32 and {r["n"] for r in found} == {n}
    assert {r["identity_error"] < 1e-9 for r in found} == {True}
    by_id = defaultdict(dict)
    for r in found:
        by_id[r["key"]][r["component"]] = r
        assert math.isclose(r["explained"], e[r["component"] - 1] / e.sum(), rel_tol=1e-9)
    sign = {}
    for (key, *_), row, near in zip(rows, x, centred):
        exact = sum((n * int(v) - t) ** 2 for v, t in zip(row, s))
        want = near @ vec[:, :32] / np.sqrt(e[:32])
        for k, r in by_id[key].items():
            assert r["deviation"] == exact
            sign.setdefault(k, math.copysign(1, r["whitened"] * want[k - 1]))
            assert abs(r["whitened"] - sign[k] * want[k - 1]) < 1e-8


def test_whitening_of_few_vectors(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, [0.5, 0.25], None, 1)] * 3)).count() == 0
    two = whitening.whiten(vectors_of(spark, [(1, [0.5, 0.25], None, 1), (2, [0.75, 0.0], None, 1)])).collect()
    assert [r["component"] for r in two] == [1, 1] and sorted(round(r["whitened"], 12) for r in two) == [-1, 1]


def test_factors_of_many_blocks_are_reduced_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "STACK", 1)
    rng = np.random.default_rng(4)
    rows = vectors_of(spark, [(i, v.tolist(), None, 1) for i, v in enumerate(rng.standard_normal((90, 5)))])
    found = whitening.whiten(rows.repartition(9))
    assert found.count() == 450 and found.agg(F.max("identity_error")).first()[0] < 1e-10


# --- manifest ---------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climbed(nodes, at):
    """(top, sibling pairs of node ``at``) of one tree."""
    pairs = []
    while len(nodes) > 1:
        low = at // 8 * 8
        pairs.append(("".join(nodes[low:at]), "".join(nodes[at + 1:low + 8])))
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
        at //= 8
    return nodes[0], pairs


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        head = "".join(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars"))
        leaf = sha(head + field(r["text"]))
        changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        used = sha(head + field(lower(r["text"]))) if changed else leaf
        trees[r["lang"]].append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf), r["doc_id"], leaf, used))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    subroots = []
    for lang in order:
        trees[lang].sort()
        subroots.append(climbed([t[2] for t in trees[lang]], 0)[0])
    out = []
    for place, lang in enumerate(order):
        nodes = [t[2] for t in trees[lang]]
        for at, (_, doc, leaf, used) in enumerate(trees[lang]):
            subroot, pairs = climbed(nodes, at)
            root, above = climbed(subroots, place)
            for left, right in pairs + above:
                used = sha(left + used + right)
            out.append((doc, leaf, subroot, root, sha("".join(a + b for a, b in pairs + above)), used, used == root))
    return Counter(out)


@pytest.mark.parametrize("most", [1, 4])
def test_manifest_matches_brute_force(spark, documents, no_documents, most):
    found = manifest.manifest(documents, tampered=True, most=most)
    assert Counter(map(tuple, found.collect())) == brute_manifest(documents.collect())
    assert manifest.manifest(no_documents, tampered=True, most=most).collect() == []


def test_manifest_of_many_languages_and_rows(spark):
    rows = [(i % 150, f"Text {i}", None if i % 9 == 0 else f"l{i % 11}" if i % 2 else "big", "s", i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(map(tuple, manifest.manifest(docs, tampered=True, most=1).collect())) == brute_manifest(docs.collect())
    untouched = manifest.manifest(docs, most=2)
    assert untouched.where("NOT verified").count() == 0


def test_manifest_of_one_row(spark):
    docs = spark.createDataFrame([(3, "A", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    row = manifest.manifest(docs).first()
    assert row["root"] == row["subroot"] == row["leaf"] and row["proof_sha256"] == sha("")
