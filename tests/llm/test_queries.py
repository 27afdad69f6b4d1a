"""The registered queries against SQL, and the pipeline against its stages' own rules."""

import random
import re
from collections import defaultdict

import pandas as pd
import pytest
from check_oracles import compare, duck, type_differences
from test_passages import SPLIT, brute_components, brute_hits
from test_texts import brute_figures, brute_spans

import corpus_pipeline
from stratarates.llm.oracles import ORACLES
from stratarates.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    relation = duck(sf_dir).sql(ORACLES[name])
    assert not type_differences(df, relation)
    want = relation.arrow()
    want = want.read_all() if hasattr(want, "read_all") else want

    def plain(table):
        frame = table.to_pandas(types_mapper=pd.ArrowDtype).astype(object)
        return frame.where(frame.notna(), None)

    assert compare(plain(df.toArrow()), plain(want)) is None


@pytest.mark.parametrize("name", ["op1_pii", "op3_chat"])
def test_native_queries_run_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    ids = [r["doc_id"] for r in rows]
    assert len(set(ids)) == len(ids) and set(ids) < {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert all(r["round_trip"] for r in rows)


def test_stages_keep_columns(spark, sf_dir, documents, no_documents):
    for docs in (documents, no_documents):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, no_documents, sf_dir).count() == 0


def plain_line(line):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in SPLIT.findall(line)]
    return " ".join(words)


def brute_quality(rows):
    """The rows that stay, without the lines that many texts of their host have."""
    texts, frequent = defaultdict(set), defaultdict(set)
    for r in rows:
        texts[r["source"]].add(r["text"])
        for line in (r["text"] or "").split("\n"):
            frequent[r["source"], plain_line(line)].add(r["text"])
    out = []
    for r in rows:
        n, _, _, _, repeated = brute_figures(r["text"])
        lines = (r["text"] or "").split("\n")
        over = [plain_line(x) != "" and 20 <= (k := len(frequent[r["source"], plain_line(x)]))
                and k > 0.05 * len(texts[r["source"]]) for x in lines]
        clean = sum(not set(w) & set("#*$%&|<>") for x, gone in zip(lines, over) if not gone for w in SPLIT.findall(x))
        if n >= 10 and 100 * repeated <= 20 * n and clean >= 0.25 * n:
            text = "\n".join(x for x, gone in zip(lines, over) if not gone)
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def brute_redaction(text):
    at, out = 0, ""
    for start, stop, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in brute_spans(text).split(",") if s)):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, stop)
    return out + text[at:]


def test_stages_match_brute_force(spark, sf_dir):
    """Every stage on what brute force kept of the stage before."""
    pick = random.Random(8)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    passage = max((t for _, t in items if t), key=len).split()[:14]
    words = [f"w{k}x" for k in range(900)]

    def prose(n):
        return " ".join(pick.choice(words) for _ in range(n))

    rows = []
    for i in range(150):
        text = prose(pick.randint(3, 90))
        if i % 3 == 0:
            text += "\nShare this  PAGE with friends\n" + prose(8)
        if i % 11 == 0:
            text = f"{prose(20)} {' '.join(passage)} {prose(20)}"
        if i % 7 == 0:
            text += " write to me@ex.org or 10.0.0.1 soon"
        if i % 13 == 0:
            text = " | ".join(prose(1) for _ in range(40)) + " $ % & | < >" * 30
        if i % 17 == 0:
            text = prose(6) * 9
        rows.append(text)
    for i in range(60):  # near and exact copies
        copy = rows[i % 25].split(" ")
        for _ in range(i % 4):
            copy[pick.randrange(len(copy))] = pick.choice(words)
        rows.append(" ".join(copy))
    rows = [{"doc_id": i, "text": t, "lang": "en", "source": f"host{i % 2}", "n_chars": len(t)} for i, t in enumerate(rows)]
    stages = dict(corpus_pipeline.STAGES)

    def run(name):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        return {r["doc_id"]: r.asDict() for r in stages[name](spark, docs, sf_dir).collect()}

    def same(name, want):
        assert 0 < len(want) and run(name) == {r["doc_id"]: r for r in want}, name
        return want

    first = same("quality_rules", brute_quality(rows))
    assert len(first) < len(rows) and any(a["text"] != rows[a["doc_id"]]["text"] for a in first)
    rows = first
    groups = brute_components([(r["doc_id"], r["text"]) for r in rows], 5, 80, 100)
    second = same("near_duplicates", [r for r in rows if (r["doc_id"], r["doc_id"]) in {(k, c) for k, _, c in groups}])
    assert len(second) < len(rows)
    rows = second
    hit = {k for k, _, n, _, _ in brute_hits([(r["doc_id"], r["text"]) for r in rows], items, 10) if n}
    third = same("decontamination", [r for r in rows if r["doc_id"] not in hit])
    assert len(third) < len(rows)
    rows = third
    fourth = [r | {"text": (t := brute_redaction(r["text"])), "n_chars": len(t)} for r in rows]
    assert same("personal_data", fourth) != rows
