"""Substring dedup, near-duplicates and decontamination against brute force."""

import random
import re

import pytest

from stratarates.llm import near, postings, windows

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def corpus(spark):
    """Passages shared at all alignments, copies, near copies, and a passage within one text."""
    pick = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [pick.choice(vocabulary) for _ in range(70)]
    rows = []
    for i in range(60):
        words = [pick.choice(vocabulary) for _ in range(pick.randint(1, 120))]
        if i % 3 == 0:
            a = pick.randint(0, 50)
            at = pick.randint(0, len(words))
            words[at:at] = passage[a:a + pick.randint(15, 40)]
        if i % 10 == 7:
            words = words + words
        rows.append((i, " ".join(words)))
    for i in range(60, 90):
        words = rows[i % 12][1].split()
        for _ in range(pick.randint(0, 3)):
            words[pick.randrange(len(words))] = pick.choice(vocabulary)
        rows.append((i, "\n ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def brute_repeats(rows, width=windows.WIDTH):
    last = 1 << 62
    first, found = {}, []
    for key, text in rows:
        key = last if key is None else key
        words = SPLIT.findall(text or "")
        found.append((key, words))
        for i in range(len(words) - width + 1):
            w = tuple(words[i:i + width])
            first[w] = min(first.get(w, (key, i)), (key, i))
    out = []
    for key, words in found:
        gone = set()
        for i in range(len(words) - width + 1):
            if (key, i) > first[tuple(words[i:i + width])]:
                gone.update(range(i, i + width))
        out.append((None if key == last else key, len(words), len(gone),
                    " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=repr)


def test_cover_reaches_every_offset():
    for shift in range(windows.PERIOD):
        assert any((i % windows.PERIOD in windows.COVER) and ((i + shift) % windows.PERIOD in windows.COVER)
                   for i in range(windows.PERIOD))


@pytest.mark.parametrize("name", ["corpus", "documents", "no_documents"])
def test_repeats_match_brute_force(request, name):
    docs = request.getfixturevalue(name)
    got = [tuple(r) for r in windows.without_repeats(docs).collect()]
    assert sorted(got, key=repr) == brute_repeats(texts_of(docs))


def brute_components(rows, width, part, whole):
    sets = []
    for _, text in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in SPLIT.findall(text or "")]
        if not words:
            sets.append(set())
        elif len(words) < width:
            sets.append({tuple(words)})
        else:
            sets.append({tuple(words[i:i + width]) for i in range(len(words) - width + 1)})
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and whole * len(a & b) >= part * len(a | b):
                parent[root(i)] = root(j)
    names = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            names[root(i)] = min(names.get(root(i), key), key)
    return sorted([(key, len(s), names.get(root(i)) if s else key)
                   for i, ((key, _), s) in enumerate(zip(rows, sets))], key=repr)


@pytest.mark.parametrize("name", ["corpus", "documents", "no_documents"])
@pytest.mark.parametrize("width,part", [(3, 85), (5, 80)])
def test_components_match_brute_force(request, name, width, part):
    docs = request.getfixturevalue(name)
    got = [tuple(r) for r in near.labelled(docs, width, (part, 100)).collect()]
    assert sorted(got, key=repr) == brute_components(texts_of(docs), width, part, 100)


@pytest.mark.parametrize("block", [near.BLOCK, 2000])
def test_large_group_of_near_copies(spark, monkeypatch, block):
    """Members whose links form a sparse graph: the second round must find what stars miss,
    also if a band is spread over many blocks."""
    monkeypatch.setattr(near, "BLOCK", block)
    pick = random.Random(3)
    base = [f"b{pick.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(250):
        words = list(base)
        for _ in range(pick.randint(2, 9)):
            words[pick.randrange(len(words))] = f"n{pick.randrange(5000)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in near.labelled(docs, 3, (85, 100)).collect()]
    assert sorted(got, key=repr) == brute_components(rows, 3, 85, 100)


def test_representatives_keep_columns(documents):
    kept = near.representatives(documents)
    assert kept.columns == documents.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids[0] == 1 and 2 not in ids and 9 in ids


def test_representatives_by_key_and_text(spark):
    a, b, c, d = (" ".join(f"{p}{i}" for i in range(30)) for p in "abcd")
    rows = [(3, a, "x"), (7, a + " more", "x"), *[(7, b, "x")] * 3, (None, a, "x"), *[(None, c, "x")] * 2, (8, c, "x"),
            *[(None, d, "x")] * 2, (None, d + " more", "x"), *[(None, None, "x")] * 2, (None, None, "y"), (None, "", "x"), (9, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((tuple(r) for r in near.representatives(docs).collect()), key=repr)
    one = next(r for r in got if r[1] and r[1].startswith(d))  # the less of two hashes
    assert one[0] is None
    assert got == sorted([(3, a, "x"), (7, b, "x"), (8, c, "x"), one, (None, None, "x"), (None, None, "y"), (None, "", "x"),
                          (9, None, "x")], key=repr)


def brute_hits(docs, items, width):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {}
    for item, text in items:
        words = word.findall(lower(text))
        if words:
            for i in range(max(1, len(words) - width + 1)):
                phrases.setdefault(tuple(words[i:i + width]), set()).add(item)
    out = []
    for key, text in docs:
        words, hit, found = word.findall(lower(text)), set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(words) - n + 1):
                if names := phrases.get(tuple(words[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= {str(name) for name in names if name is not None}
        out.append((key, len(words), len(hit), len(found), sorted(found)))
    return sorted(out, key=repr)


ITEMS = [("1", "the quick0 Brown0 fox0 jumps0 over0 a0 lazy0 dog0 while0 seven0 wizards0"), ("10", "one"), ("2", None),
         (None, "one"), ("3", "ONE one"), ("4", ""), ("", "w20 w21 w22"), ("a,b", "w30 w31 w32"), ("a", "w30 w31 w32"),
         (None, "w40 w41"), (None, "jumps3 over3 a3 lazy3"), ("10", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]


@pytest.mark.parametrize("limit", [postings.GROUP_PHRASES, 2])
def test_phrases_match_brute_force(spark, documents, monkeypatch, limit):
    """Also with so small groups of phrases that several passes are needed."""
    monkeypatch.setattr(postings, "GROUP_PHRASES", limit)
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = postings.contamination(documents, items).select("doc_id", "n_words", "n_hit", "n_items", "items")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_hits(texts_of(documents), ITEMS, 10)


def test_phrases_of_empty_tables(spark, documents, no_documents):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert postings.contamination(no_documents, items).count() == 0
    assert postings.contamination(documents, items.where("false")).where("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b x c d"), (2, "a b c d"), (3, "d c b a"), (4, "a b x y z c d")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([("i", "a b c d")], "item_id string, text string")
    exact = postings.contamination(docs, items, width=4)
    near_ = postings.contamination(docs, items, width=4, slop=1)
    assert [r["doc_id"] for r in exact.where("n_hit > 0").collect()] == [2]
    assert sorted(r["doc_id"] for r in near_.where("n_hit > 0").collect()) == [1, 2]

