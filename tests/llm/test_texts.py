"""Personal data, HTML, chat, toxicity, quality rules, WARC and BPE on small tables."""

import gzip
import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratarates.llm import boosting, bpe, chat, lines, pages, pii, toxicity, warc
from stratarates.llm.queries import QUERIES, vocabulary

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


# --- personal data --------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)
                    or kind == "phone" and 9 <= len(digits) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


PERSONAL = [
    "a@b.c_d@e.f x@y z@q.", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.004", "4111 1111 1111 1111 4111-1111-1111-1112",
    "+1 (443) 555-5793 +12 +123456789012345678", "é😀 me@ex.org, +44 20 7946 0958.", "", None,
    "9" * 3000, "a" * 3000 + "@" + "b." * 1000 + "c", "(443) 555-5793", "1 2 3 4 5 6 7 8 9 0 1 2 3",
    "joe (at) example (dot) org", "1.1.1.1" * 40, "@a.b +-+1 --", "0000000000000000",
]


def test_base_spans_match_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.summary(docs).collect()}
    for i, text in enumerate(PERSONAL):
        want = brute_spans(text)
        assert got[i]["base"] == want, text
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
        kinds = Counter(s.split(":")[0] for s in want.split(",") if s)
        assert [got[i][f"n_{k}"] for k in BASE] == [kinds[k] for k in BASE]


def test_trees_decide_on_look_alikes(spark, monkeypatch):
    texts = ["call (443) 555-5793 now", "call +1 (443) 555-5793", "no 12345678"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda: [r["spans"] for r in pii.summary(docs).orderBy("doc_id").collect()]
    assert found() == ["phone:5:19", "phone:5:22", ""]  # three rows have trees, too
    names = [f.name for f in pii._features(F.struct(*(F.lit("").alias(c) for c in ("s", "before", "after")),
                                                    F.lit(0).alias("start"), F.lit(0).alias("stop")))]
    bracket = boosting.Split(names.index("bracketed"), 0.5, -1.0, 1.0)
    monkeypatch.setattr(pii, "_fitted", lambda *_: (boosting.Boosted([bracket], [1.0]), 0.8))
    assert found() == ["phone:5:19", "phone:5:22", ""]


def test_fitted_trees_find_wide_forms(spark):
    pick = random.Random(4)
    digits = lambda n: "".join(pick.choice("0123456789") for _ in range(n))
    prose = "the of and thence ueadoos rai enülicher erg nding token account".split()
    rows = []
    for _ in range(700):
        card = "4" + digits(15)
        parts = [f"+1 ({digits(3)}) 555-{digits(4)}", f"{pick.choice(prose[:4])}.{digits(2)}@site{digits(1)}.example.org",
                 card, f'"{digits(1)}af{digits(9)}c{digits(8)}"', ".".join(str(pick.randint(1, 999)) for _ in range(4)),
                 card[:-1] + next(c for c in "0123456789" if luhn(card[:-1] + c))]
        rows.append(" ".join(pick.choice(prose) + " " + p + " " + pick.choice(prose) for p in pick.sample(parts, 3)))
    wanted = {"call (443) 555-5793 now": "phone:5:19", "or 443-555-5793, he said": "phone:3:15",
              "write to joe (at) example (dot) org soon": "email:9:35", "pay 4111.1111.1111.1111 now": "card:4:23"}
    others = ["no 4111111111111112 here", "no 4111.1111.1111.1112 here", "at 2024-01-15 10 sharp", "no 300.400.500.600 now",
              'id "7af443555579c3" set', "a bare 1443555579 is no phone"]
    docs = spark.createDataFrame([(t,) for t in [*rows, *wanted, *others]], "text string")
    found = {r["text"]: r["spans"] for r in pii.summary(docs, key="text").collect()}
    assert {t: found[t] for t in wanted} == wanted
    assert {t: found[t] for t in others} == dict.fromkeys(others, "")


def test_small_tables_have_trees(spark, sf_dir):
    """Wide forms and look-alikes beside the texts of the smallest table, and with no others."""
    wanted = {"write to joe (at) example (dot) org soon": "email:9:35", "call (443) 555-5793 now": "phone:5:19",
              "443-555-5793": "phone:0:12", "4111.1111.1111.1111": "card:0:19"}
    others = ["at 2024-01-15 10 sharp", "no 4111.1111.1111.1112 here", "a bare 1443555579 is no phone"]
    made = spark.createDataFrame([(t,) for t in [*wanted, *others]], "text string")
    for docs in (made, made.union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"))):
        found = {r["text"]: r["spans"] for r in pii.summary(docs, key="text").collect()}
        assert {t: found[t] for t in wanted} == wanted
        assert {t: found[t] for t in others} == dict.fromkeys(others, "")


def test_trees_learn_from_all_texts(spark, monkeypatch):
    """More texts than were once sampled: every one of its half is counted, as is every row that calibrates."""
    seen, fit = [], boosting.fit
    monkeypatch.setattr(boosting, "fit", lambda rows, *a, **k: seen.append(rows) or fit(rows, *a, **k))
    text = F.concat(F.lit("call +1 (443) 555-0142 or id"), F.col("id"))
    for rows in (0, 30_000):
        docs = spark.range(rows).select("id", text.alias("text"))
        assert pii.summary(docs, key="id").where("n_phone = 1").count() == rows
    none, some = (r.select(F.expr("sum(if(label = 1, n, 0))")).first()[0] for r in seen)
    half = docs.where(F.abs(F.xxhash64("text", F.lit(1)) % 2) == 0).count()
    forms = {f"call {f} or" for f in ("1 (443) 555-0142", "(443) 555-0142", "443-555-0142", "443.555.0142", "443 555 0142")}
    assert some - none == half * len(forms)


def test_trees_of_weighted_rows(spark):
    """A row of weight n counts like n rows, and more than 10,000 distinct ones all give split points."""
    rows = spark.range(12_000).select(F.col("id").cast("double").alias("x"), (F.col("id") == 11_999).cast("int").alias("y"),
                                      F.lit(1).alias("n"))
    trees = boosting.fit(rows, ["x"], "y", trees=3, weight="n")
    assert {s.feature for s in trees.trees if isinstance(s, boosting.Split)} == {0}
    few = spark.createDataFrame([(0.0, 0, 3), (0.0, 1, 1), (1.0, 1, 2)], "x double, y int, n int")
    many = few.select("x", "y", F.explode(F.sequence(F.lit(1), "n")).alias("n"))
    assert boosting.fit(few, ["x"], "y", weight="n").trees[0] == boosting.fit(many, ["x"], "y").trees[0]


def test_a_long_text_of_numbers(spark):
    """A megabyte: time must not grow with the square of the matches."""
    text = "ab 12 x é 1 23456 " * 30_000 + "+1 (443) 555-5793 or me@ex.org " * 15_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.monotonic()
    row = pii.summary(docs).first()
    assert time.monotonic() - began < 90
    assert row["base"] == brute_spans(text) and row["n_phone"] == row["n_email"] == 15_000
    out = pii.redact(docs).first()["text"]
    assert out == text.replace("+1 (443) 555-5793", "[PHONE]").replace("me@ex.org", "[EMAIL]")


def test_redaction_of_overlapping_spans(spark):
    texts = ["+1 4111 1111 1111 111, 1.2.3.4", "a 1.2.3.4@ex.org b", "x" * 3000 + " me@ex.org " + "é" * 3000 + " 1.2.3.4"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["t"]: r["text"] for r in pii.redact(docs.withColumn("t", F.col("text"))).collect()}
    for text in texts:
        at, out = 0, ""
        for start, stop, kind in sorted((int(a), int(b), k) for k, a, b in
                                        (x.split(":") for x in brute_spans(text).split(","))):
            if start >= at:
                out += text[at:start] + f"[{kind.upper()}]"
            at = max(at, stop)
        assert got[text] == out + text[at:]


def test_trees_are_read_right(spark):
    import numpy as np

    pick = random.Random(9)
    rows = [(pick.random(), pick.random(), 0) for _ in range(400)]
    rows = [(a, b, int(a + b > 1)) for a, b, _ in rows]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    trees = boosting.fit(df, ["a", "b"], "y")
    p = trees.probability(np.array([r[:2] for r in rows]))
    assert np.mean((p > 0.5) == np.array([r[2] for r in rows])) > 0.95
    q = [r[0] for r in df.select(trees.expression([F.col("a"), F.col("b")])).collect()]
    assert np.allclose(sorted(p), sorted(q))
    assert boosting.fit(df.where("y = 1"), ["a", "b"], "y") is None


def test_scoring_plans_do_not_grow_with_trees(spark):
    """The driver holds plans several times: trees enter them as arrays, one branch walks through all nodes."""
    import numpy as np

    pick = random.Random(3)

    def tree(depth):
        if not depth or pick.random() < 0.1:
            return pick.uniform(-1, 1)
        return boosting.Split(pick.randrange(2), pick.random(), tree(depth - 1), tree(depth - 1))

    rows = [(i, pick.random(), pick.random()) for i in range(200)] + [(200, 0.5, float("nan"))]
    df = spark.createDataFrame(rows, "i int, a double, b double")
    for trees in (boosting.Boosted([tree(5) for _ in range(20)], [1.0] + [0.3] * 19), boosting.Boosted([0.25], [1.0])):
        for of in ([F.col("a"), F.col("b")], F.array("a", "b")):
            scored = df.select("i", trees.expression(of).alias("p"))
            got = dict(scored.collect())
            assert np.allclose([got[r[0]] for r in rows], trees.probability(np.array([r[1:] for r in rows])), rtol=1e-12, atol=0)
            assert scored._jdf.queryExecution().analyzed().toString().count("CASE") == 1


def test_personal_data_makes_each_plan_once(spark, monkeypatch):
    """Texts and examples are searched by one plan; candidates' features are written once to learn and once to score."""
    made = {"_candidates": 0, "_features": 0}

    def counted(name, of):
        def run(*args):
            made[name] += 1
            return of(*args)
        return run

    for name in made:
        monkeypatch.setattr(pii, name, counted(name, getattr(pii, name)))
    docs = spark.createDataFrame([(1, "call (443) 555-5793 now"), (None, None)], "id long, text string")
    assert sorted(r["spans"] for r in pii.summary(docs, key="id").collect()) == ["", "phone:5:19"]
    assert made["_candidates"] == 1 and made["_features"] == 2


def test_redaction(spark, documents, no_documents):
    out = pii.redact(documents)
    assert out.columns == documents.columns
    before = documents.where("doc_id = 10").first()["text"]
    want = before.replace("me@ex.org", "[EMAIL]").replace("+1 (443) 555-5793", "[PHONE]")
    assert out.where("doc_id = 10").first()["text"] == want
    same = out.where("doc_id <> 10 OR doc_id IS NULL").exceptAll(documents)
    assert same.count() == 0 and pii.redact(no_documents).count() == 0


# --- HTML -----------------------------------------------------------------------------

ARTICLE = ("<html><head><title>no</title></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy this now.</div>"
           "<article><h1>Title {i}</h1><p>First &amp; foremost, text of page {i}\n goes  on.<br><p>Second {i}, as long as "
           "the first one, &lt;more&gt;.</p></article><!-- c --><footer>All rights</footer><script>var t='</p>';</script>")


@pytest.fixture(scope="module")
def site(spark):
    rows = [(i, f"http://h/{i}", ARTICLE.format(i=i)) for i in range(40)] + [(None, None, None), (99, None, "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_main_text(site):
    got = {r["page_id"]: r["text"] for r in pages.extract(site).collect()}
    assert len(got) == 42 and got[None] == "" and got[99] == ""
    for i in range(40):
        assert got[i] == (f"Title {i}\n\nFirst & foremost, text of page {i} goes on.\n\n"
                          f"Second {i}, as long as the first one, <more>.")


def test_main_text_of_other_layouts(spark, site):
    trees = pages.fit(site)
    page = ("<body><header>Site</header><main><p>Some text of the page, which goes on for long.</p><aside class='related'>See also</aside>"
            "</main><section class='comments'><p>First!</p></section></body>")
    assert pages.main_text(page, trees) == "Some text of the page, which goes on for long."
    assert pages.main_text("just text", None) == "just text"
    assert pages.main_text("<div>" * 5000 + "deep", trees) == "deep"
    assert pages.fit(site.where("false")) is None and pages.extract(site.where("false")).count() == 0


@pytest.mark.parametrize("head, text", [
    ("<head><title>no</title><meta charset=x><body>", "<p>A</p><p>B</p>"),
    ("<head><title>no</title><script>s</script>", "<p>A</p><p>B</p>"), ("<head><title>no</title>", "A<p>B</p>"),
    ("<head><noscript><img src=x>no</noscript><title>no</title></head>", "<p>A</p><p>B</p>"),
    ("<head></head>", "<p><math><mi>A</mi></math></p><object><p>B</p></object>"), ("", "<noscript><p>A</p><p>B</p></noscript>")])
def test_main_text_without_end_of_head(head, text):
    assert pages.main_text(f"<html>{head}{text}", None) == "A\n\nB"


def test_decoding_is_consistent():
    pick = random.Random(2)
    import numpy as np

    for _ in range(200):
        n = pick.randint(2, 9)
        parent = [-1] + [pick.randrange(i) for i in range(1, n)]
        p = np.array([pick.uniform(0.01, 0.99) for _ in range(n)])
        best, choice = None, None
        for bits in range(1 << (n - 1)):
            keep = [True] + [bool(bits >> i & 1) for i in range(n - 1)]
            if all(not keep[i] or keep[parent[i]] for i in range(1, n)):
                value = sum(np.log(p[i] if keep[i] else 1 - p[i]) for i in range(1, n))
                if best is None or value > best:
                    best, choice = value, keep
        assert pages.decode(parent, p).tolist() == choice


# --- chat -----------------------------------------------------------------------------

def test_prefixes_collapse(spark):
    said = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["a"], 5: ["a", "x"], 6: ["b"], 7: [None], 8: [""],
            None: ["q"], 9: ["ab"]}
    rows = [(k, i, "user" if i % 2 == 0 else "assistant", t, "extra") for k, v in said.items() for i, t in enumerate(v)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, h1 string")
    got = {r["conv_id"]: r for r in chat.render(df).collect()}
    assert set(got) == {2, 5, 6, 7, 8, 9, None}
    assert got[2]["copies"] == 2 and got[2]["n_turns"] == 3
    assert got[2]["text"] == "<|user|>\na\n<|assistant|>\nb\n<|user|>\nc"
    assert chat.render(df.where("false")).count() == 0
    plan = chat.render(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_turns_without_an_id_stand_alone(spark):
    """A third of all rows has no id; equal ones are one, and prefixes of others go."""
    rows = [(None, i, "user", f"q{i % 7}") for i in range(300)] + [(None, 0, None, None), (None, 5, "user", "a")]
    rows += [(k, i, "user", "q3" if k == 1 and i == 0 else f"{k}-{i}") for k in range(100) for i in range(6)]
    rows += [(200, 0, "user", "a"), (200, 1, "user", "b"), (201, 0, "user", "q5")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = [tuple(r) for r in chat.render(df).collect()]
    alone = sorted((r for r in got if r[0] is None), key=repr)
    of = Counter(f"q{i % 7}" for i in range(300))
    want = [(None, 1, of[f"q{k}"], f"<|user|>\nq{k}") for k in range(7) if k not in (3, 5)] + [(None, 1, 1, "<|user|>\n")]
    assert alone == sorted(want, key=repr)  # q3 and a begin others
    assert (201, 1, of["q5"] + 1, "<|user|>\nq5") in got and len(got) == len(want) + 102


# --- toxicity -------------------------------------------------------------------------

def test_segments_match_brute_force():
    import numpy as np

    def brute(x):
        """Split off the best segment, the longest of ties, left of it and right of it again."""
        best = None
        for i in range(len(x)):
            for j in range(i + 1, len(x) + 1):
                s = sum(x[i:j])
                if s > 0 and (best is None or s > best[0] + 1e-9):
                    best = s, i, j
        if best is None:
            return []
        _, i, j = best
        return brute(x[:i]) + [(i, j - 1)] + [(a + j, b + j) for a, b in brute(x[j:])]

    pick = random.Random(3)
    for _ in range(300):
        x = [pick.uniform(-1, 1) for _ in range(pick.randint(0, 14))]
        got = [(s.first, s.last) for s in toxicity.maximal_segments(np.array(x))]
        assert got == brute(x), x


def test_toxic_texts_score_high(spark):
    pick = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(900):
        text = [pick.choice(words) for _ in range(60)]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(4):
                text.insert(pick.randrange(60), pick.choice(["vileness", "grubling", "scornfully"]))
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _, _ in rows if got[i]["held_out"]]
    assert len(held) > 200 and len(got) == 902
    assert sum(got[i]["predicted"] == rows[i][2] for i in held) >= 0.98 * len(held)
    assert got[None]["predicted"] == 0 and got[1000]["predicted"] == 0 and not got[None]["held_out"]
    none = toxicity.fit(docs, labels.where("false"))
    assert {r["predicted"] for r in toxicity.score(docs, none).collect()} == {0}


def test_a_labelled_key_counts_once(spark):
    """A third of all rows repeats one labelled key."""
    rows = [(i, f"word{i % 50} fine words here", int(i % 9 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t + (" grubling" if y else "")) for i, t, y in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    hot = docs.union(spark.range(300).selectExpr("3L", "concat('word1 zz ', id)")).union(docs.where("doc_id = 3"))
    one, other = toxicity.fit(docs, labels), toxicity.fit(hot, labels)
    assert (one.rate, one.scale, one.slope, one.offset) == (other.rate, other.scale, other.slope, other.offset)
    assert (one.total == other.total).all() and (one.toxic == other.toxic).all()


# --- quality --------------------------------------------------------------------------

def brute_figures(text):
    text = text or ""
    words = SPLIT.findall(text)
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    cover = {j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    some = [x for x in text.split("\n") if SPLIT.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(some) - len(set(some)), len(cover))


def test_figures_match_brute_force(documents, no_documents):
    texts = {(r["doc_id"], r["text"]): brute_figures(r["text"]) for r in documents.collect()}
    got = lines.verdicts(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = [(r["doc_id"], *texts[r["doc_id"], r["text"]]) for r in documents.collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert lines.verdicts(no_documents).count() == 0 and lines.filtered(no_documents).count() == 0


def test_frequent_lines_go_and_copies_stay(spark):
    pick = random.Random(6)
    prose = lambda n: " ".join(f"p{pick.randrange(10_000)}" for _ in range(n))
    copied = prose(15) + "\n" + prose(15)
    rows = [(i, f"Share this  page\n{prose(20)}", "h") for i in range(60)]
    rows += [(i, "share THIS page\n" + prose(1) + "\nshare this page now and then or whenever you like", "h") for i in range(60, 90)]
    rows += [(i, copied, "h") for i in range(100, 200)]
    rows += [(300, "share this page\n" + prose(20), "other"), (301, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["text"] for r in lines.filtered(docs).collect()}
    assert set(kept) == {*range(60), *range(100, 200), 300}
    assert all(kept[i] == rows[i][1].split("\n")[1] for i in range(60))
    assert all(kept[i] == copied for i in range(100, 200)) and kept[300].startswith("share this page")


# --- WARC -----------------------------------------------------------------------------

def test_round_trip(spark, tmp_path):
    long = "<p>é</p>" * 50_000
    rows = [(3, "u3", long), (1, "u1\nx", "<p>same</p>" * 20), (2, "u2", "<p>same</p>" * 20), (4, None, None), (5, "u", "short"),
            (6, "u", "short"), (None, "n", "<p>same</p>" * 20), (1, "u1", "<p>same</p>" * 20)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    archives = warc.write(df, str(tmp_path / "w"), archive_bytes=2000)
    assert archives.count() > 1
    got = sorted((tuple(r) for r in warc.read(archives).select(
        "key", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload").collect()), key=repr)
    same = rows[1][2].encode()
    want = []
    for key, _, html in rows:
        raw = (html or "").encode()
        revisit = raw == same and key != 1
        want.append((key, "revisit" if revisit else "response", len(raw), hashlib.sha256(raw).hexdigest(),
                     1 if revisit else None, None if revisit else bytearray(raw)))
    assert got == sorted(want, key=repr)
    assert warc.read(warc.write(df.where("false"), str(tmp_path / "e"))).count() == 0


def test_folders_lie_where_spark_reads_them(spark):
    assert warc._located(spark, "/some/where") == "file:/some/where"
    assert warc._located(spark, "file:///some/where") == "file:/some/where"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://store")
    conf.set("fs.viewfs.mounttable.store.link./in", "file:///tmp")
    try:
        assert warc._located(spark, "/in/warc") == "viewfs://store/in/warc"
    finally:
        conf.set("fs.defaultFS", before)


def test_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "<p>text</p>" * 30)], "page_id long, url string, html string")
    path = warc.write(df, str(tmp_path / "w")).first()["path"]
    raw = gzip.decompress(open(path, "rb").read())
    for bad in (raw.replace(b"text", b"tExt", 1), raw[:-4], raw[:-40], raw + b"x"):
        with open(path, "wb") as f:
            f.write(gzip.compress(bad))
        with pytest.raises(ValueError), open(path, "rb") as f:
            list(warc.records(f))


# --- BPE ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def codecs():
    import tiktoken

    ranks, pattern = vocabulary()
    return bpe.Codec(ranks, pattern), tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(codecs):
    mine, theirs = codecs
    pick = random.Random(7)
    texts = ["", " ", "a", "\x1c \x85b　c", "it's  we'll\n\n x", "😀 漢字 ½²٣", "<|endoftext|>", "a" * 3000, "ab" * 2000]
    for alphabet in ("ab é\n", "abcdefghijklmnopqrstuvwxyzüß", "aaab", " \t\n\xa0.,x1"):
        texts += ["".join(pick.choice(alphabet) for _ in range(pick.randint(1, 2000))) for _ in range(25)]
    for text in texts:
        packed = mine.encode(text)
        assert bpe.unpack(packed) == theirs.encode_ordinary(text)
        assert mine.decode(packed).decode() == text


def test_table_of_texts(documents, no_documents, codecs):
    ranks, pattern = vocabulary()
    out = bpe.decode(bpe.encode(documents, ranks, pattern), ranks, pattern)
    rows = out.collect()
    assert len(rows) == documents.count() and set(documents.columns) < set(out.columns)
    for r in rows:
        text = r["text"] or ""
        assert bytes(r["decoded"]).decode() == text
        assert bpe.unpack(bytes(r["ids"])) == codecs[1].encode_ordinary(text) and r["n_tokens"] * 4 == len(r["ids"])
    assert bpe.encode(no_documents, ranks, pattern).count() == 0


def test_joins_merge_few_bytes(codecs):
    """Most seams are known from their two tokens: no bytes around them are merged anew."""
    pick, merged = random.Random(5), []

    class Counted(bpe.Codec):
        def _merge(self, piece):
            merged.append(len(piece))
            return super()._merge(piece)

    counted = Counted(*vocabulary())
    syllables = "the in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha".split()
    text = " ".join("".join(pick.choice(syllables) for _ in range(pick.randint(2, 7))) for _ in range(20_000))
    assert bpe.unpack(counted.encode(text)) == codecs[1].encode_ordinary(text)
    assert sum(merged) < 1.1 * len(text)


def test_query_makes_one_pass(spark, sf_dir):
    """Texts are encoded and decoded by the same workers."""
    plan = QUERIES["op9_bpe"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


# --- memory of workers ----------------------------------------------------------------

def test_workers_stay_small():
    """What a worker remembers of pieces, and what hashing two megabytes of words takes."""
    import tracemalloc

    import pyarrow as pa

    from stratarates.llm import words

    codec = bpe.Codec(*vocabulary())
    for i in range(0, 250_000, 1000):
        codec.encode(" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{k}" for k in range(i, i + 1000)))
    assert len(codec.known) + len(codec.known.older) <= 200_000 and codec.short.cache_info().currsize <= 1 << 16
    column = pa.array(["the quick brown fox " * 100] * 1000)
    words.give_back()
    tracemalloc.start()
    words.Words(column).hash
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
