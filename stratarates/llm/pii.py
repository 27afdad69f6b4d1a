"""Personal data by candidate boosting, in built-in expressions only.

Generators with high recall propose spans that may overlap: the four base kinds, any run of
digits with separators, and addresses that spell out their signs.  The valid base spans
always stay.  Every other candidate is scored by boosted trees over its format (digits,
groups, separators, check digit, brackets) and its context (the characters beside it, words
before it), and is redacted if its score reaches a threshold that was calibrated on other
documents: the least threshold at which a share ``PRECISION`` of the accepted are valid.

What the base rules find needs no trees, so these learn what the rules cannot see: the valid
base spans of all texts are rewritten in wide forms
(phones without plus sign or country code, cards in other groups, addresses spelt out) and
stand, in their own context, against look-alikes: candidates that the rules judge invalid,
broken check digits, dates with an hour, bare digits, prose with "at" and "dot".  Candidates
that may be either (grouped digits without a plus sign, spelt addresses) are not learnt
from, only scored.  Every text gives its rows to one of two halves, by hash: one for the trees, one
for the threshold.  Rows with equal features are one row with a weight, so what is learnt from
grows with the forms that occur, not with the texts.  The threshold has a prior: a
score counts as ``PRIOR_ROWS`` rows of which that share is valid, and without any rows the
threshold is ``PRECISION`` itself.  ``EXAMPLES``, a few made-up sentences, are learnt from
in both halves, so small and empty tables have trees as well; with few valid spans in a table,
what is added rests on the examples and the prior.  Texts are searched once: their candidates
are staged, learnt from and scored.  Scoring is an
expression over the array of a row's candidates, so it covers all texts whole, needs no
shuffle, and rows need no key: null keys, repeated rows and ties give a row each.

Null texts count as empty; empty texts have no spans.  Positions count code points, ends are
exclusive.  All patterns start at run boundaries and use possessive repetition, ends are found by
running sums, overlaps by binary search, and pieces of a text by way of its parts, so a text with
n spans takes n log n steps and no array grows one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratarates.llm import boosting, scratch

PRECISION = 0.99
#: what a score says by itself weighs like so many calibration rows
PRIOR_ROWS = 20
#: a text is cut into parts of so many characters to reach its spans
PART = 1024
KINDS = ("email", "ip", "card", "phone")

# Leftmost matches begin where a run of their characters begins, or right behind a match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "number": r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    "spelt": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?"
             r"[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{2,}+)++",
}
#: made-up sentences with valid spans that both halves hold
EXAMPLES = (
    "Call me at +1 (443) 555-0142 before noon.", "My phone: +1 (212) 555-0187, ask for Ann",
    "tel +44 20 7946 0958", "Reach the office on +49 30 5550 1234 or by mail.", "fax=+33 1 5550 0199;",
    "please ring +1 415-555-0119 tomorrow", "contact +61 2 5550 4321, day or night", "+1 (617) 555-0133 is her mobile",
    "The card 4111 1111 1111 1111 was charged.", "pay with 5555 5555 5555 4444, valid until May",
    "card=4012888888881881", "Visa 4222 2222 2222 2220 is on file", "account 5105105105105100 closed", "my card is 6011 1111 1111 1117",
    "Write to joe.bloggs@example.org today.", "mail: ann_lee@mail.example.com", "<support@example.net>",
    "her address is m.rossi@example.co.uk, I think", "contact=kim99@example.edu", "Please send it to info@example.de or call.",
)
#: words that may stand before personal data
CUES = "mail|phone|tel|call|fax|mobile|contact|card|visa|account|address|server|host|token|key|hash|id"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _two_to(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


def _passes(values: Column) -> Column:
    return F.floor(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")


def _running(values: Column, joined: Callable[[Column, Column], Column]) -> Column:
    """Running sums or maxima of whole numbers: pass k joins each with that 2**k places before, so n
    values take n log n steps and no array grows one by one."""
    return _let(values, lambda v: F.aggregate(
        F.sequence(F.lit(0), _passes(v)), v, lambda a, k: F.transform(
            a, lambda x, i: joined(x, F.coalesce(F.get(a, i - _two_to(k)), F.lit(0))))))


def spans(text: str, pattern: str, worth: str) -> Column:
    """array<struct<start, stop, s, before, after>> of the matches in column ``text``: up to 16
    characters before each, not beyond the start of the match before it, and up to 4 behind.
    A text that fails the cheap test ``worth`` has none."""
    kind = "array<struct<start:int,stop:int,s:string,before:string,after:string>>"

    def placed(x: Column) -> Column:
        found, gaps = x["found"], x["gaps"]
        ends = _running(F.transform(found, lambda m, i: F.char_length(m) + F.char_length(F.get(gaps, i))), lambda a, b: a + b)
        return _let(ends, lambda end: F.transform(found, lambda m, i: F.struct(
            (F.get(end, i) - F.char_length(m)).alias("start"), F.get(end, i).alias("stop"), m.alias("s"),
            F.substring(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(gaps, i)), -16, 16).alias("before"),
            F.substring(F.concat(F.get(gaps, i + 1), F.coalesce(F.get(found, i + 1), F.lit(""))), 1, 4).alias("after"))))

    of = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
                  F.split(text, pattern, -1).alias("gaps"))
    return F.when(F.expr(worth), _let(of, placed)).otherwise(F.expr(f"CAST(array() AS {kind})"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: str, s: Column) -> Column:
    n = F.char_length(_digits(s))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
            F.split(s, r"\."), lambda p: F.substring(F.concat(F.lit("000"), F.ltrim(p, F.lit("0"))), -3, 3) <= "255")
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", _digits(s))
    return n.between(9, 15)


def _only_valid(kind: str) -> Column:
    return F.filter(f"__{kind}", lambda s: _valid(kind, s["s"]))


_WORTH = {"email": "instr(__t, '@') > 0", "ip": "__d AND instr(__t, '.') > 0", "card": "__d",
          "phone": "__d AND instr(__t, '+') > 0", "number": "__d",
          "spelt": r"__t rlike r'(?i)(?:\(at\)|\[at\]|\x20at\x20)'"}


def _base(docs: DataFrame) -> DataFrame:
    """``docs`` with arrays of the valid spans of each kind and of all wide candidates of ``__t``."""
    out = docs.withColumn("__d", F.expr("__t rlike '[0-9]'"))
    out = out.withColumns({f"__{k}": spans("__t", p, _WORTH[k]) for k, p in (PATTERNS | WIDE).items()})
    return out.withColumns({f"__{k}": _only_valid(k) for k in KINDS[1:]})


class Feature(NamedTuple):
    name: str
    of: Column


def _features(c: Column) -> list[Feature]:
    """Features of a candidate ``c`` with start, stop, s, before, after."""
    s, before, after = c["s"], c["before"], c["after"]
    digits = _digits(s)

    def count(pattern: str) -> Column:
        return F.char_length(s) - F.char_length(F.regexp_replace(s, pattern, ""))

    flags = {
        "plus": s.startswith("+"), "luhn": F.call_function("luhn_check", digits),
        "octets": s.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"),
        "glued_before": before.rlike(r"[A-Za-z0-9_]$"), "glued_after": after.rlike(r"^[A-Za-z0-9_]"),
        "quoted": before.rlike(r"[\"'=]$"), "cue": before.rlike(rf"(?i)(?:{CUES})\W*$"),
        "spelt": s.rlike(r"(?i)at"), "bracketed": s.contains("(") | s.contains("["),
        "domain": s.rlike(r"(?i)[^a-z](?:com|org|net|edu|gov|mil|int|info|biz|[a-z]{2})$"),
    }
    numbers = {
        "digits": F.char_length(digits), "length": c["stop"] - c["start"], "spaces": count(r"\x20"),
        "dots": count(r"\."), "dashes": count("-"),
        "groups": F.size(F.split(F.regexp_replace(s, "[^0-9]+", " "), " ")),
        "zero_lead": F.when(digits.startswith("0"), 1).otherwise(0),
        "first_group": F.char_length(F.regexp_extract(s, r"^[^0-9]*+([0-9]*+)", 1)),
        "last_group": F.char_length(F.regexp_extract(s, r"([0-9]*+)[^0-9]*+$", 1)),
    }
    return [*(Feature(k, v.cast("double")) for k, v in numbers.items()),
            *(Feature(k, F.coalesce(v, F.lit(False)).cast("int").cast("double")) for k, v in flags.items())]


def _overlaps(c: Column, of: str) -> Column:
    """Whether ``c`` overlaps one of the spans in column ``of``, which ascend and lie apart: a
    binary search for the first that ends behind its start."""
    all_of = F.col(of)
    steps = F.sequence(_passes(all_of), F.lit(0), F.lit(-1))
    at = F.aggregate(steps, F.lit(0), lambda low, k: F.when(
        F.coalesce(F.get(all_of, low + _two_to(k) - 1)["stop"] <= c["start"], F.lit(False)), low + _two_to(k)).otherwise(low))
    return F.coalesce(F.get(all_of, at)["start"] < c["stop"], F.lit(False))


def _candidates(base: DataFrame) -> DataFrame:
    """Marks wide candidates that overlap a valid base span."""
    def seen(c: Column) -> Column:
        known = reduce(lambda a, b: a | b, (_overlaps(c, f"__{k}") for k in KINDS))
        return F.struct(*(c[k].alias(k) for k in ("start", "stop", "s", "before", "after")), known.alias("known"))

    return base.withColumns({f"__{k}": F.transform(f"__{k}", seen) for k in WIDE})


def _refused(c: Column) -> Column:
    """Whether a candidate that holds no valid span is surely none: the base rules judge it, it is
    part of a token, or it has no form at all."""
    s, digits = c["s"], _digits(c["s"])
    n = F.char_length(digits)
    return ~s.rlike("(?i)at") & (
        c["before"].rlike(r"[A-Za-z0-9_]$") | c["after"].rlike(r"^[A-Za-z0-9_]") | (n < 9) | (n > 19)
        | ((n > 15) & ~F.coalesce(F.call_function("luhn_check", digits), F.lit(False))) | s.startswith("+")
        | s.rlike(r"^[0-9]++$") | ((n <= 12) & s.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")))


def _rewritten(kind: str, s: Column) -> list[tuple[int, Column]]:
    """Wide forms of a valid span (1) and look-alikes made of it (0)."""
    d = _digits(s)
    if kind == "phone":
        local = F.regexp_replace(s, r"^\+[0-9]{1,3}[\x20.-]+(?=[(0-9])", "")
        bare = F.regexp_replace(local, "[()]", " ")
        forms = [F.substr(s, F.lit(2)), local, *(F.regexp_replace(F.trim(bare), r"[\x20.-]+", sign) for sign in "-. ")]

        def date(form: str) -> Column:
            places = [F.substr(d, F.lit(k), F.lit(1)) for k in (3, 4, 5, 6, 7)]
            return F.format_string(form, *places)

        return [*((1, F.when(~f.startswith("+") & ~f.rlike("^[0-9]*$") & F.char_length(_digits(f)).between(9, 15), f))
                  for f in forms),
                (0, date("20%s%s-0%s-1%s 1%s")), (0, date("20%s%s.0%s.1%s 1%s")), (0, date("2%s.0%s.20%s%s 1%s")), (0, d)]
    if kind == "card":
        wrong = F.concat(F.substr(d, F.lit(1), F.char_length(d) - 1), ((F.right(d, F.lit(1)).cast("int") + 1) % 10).cast("string"))
        return [(label, F.regexp_replace(of, "([0-9]{4})(?=[0-9])", "$1" + sign))
                for label, of, signs in ((1, d, (".", "  ", "- ")), (0, wrong, ("", " ", ".", "  ", "- "))) for sign in signs]
    local, domain = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
    prose = F.concat(local, F.lit(" at "), F.substring_index(domain, ".", 1), F.lit(" dot "),
                     F.reverse(F.substring_index(domain, ".", -1)), F.lit("ing"))
    return [*((1, F.concat(local, F.lit(at), F.replace(domain, F.lit("."), F.lit(dot)))) for at, dot in (
        (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", " dot "))), (0, prose)]


def _lessons(wide: DataFrame) -> DataFrame:
    """(fold, label, c) of what the trees can learn from in the candidates and base spans of ``wide``."""
    def made(kind: str) -> Column:
        pattern = WIDE["spelt" if kind == "email" else "number"]
        of = F.flatten(F.transform(f"__{kind}", lambda b: F.array(*(
            F.struct(F.lit(label).alias("label"), F.struct(
                F.lit(0).alias("start"), F.char_length(s).alias("stop"), s.alias("s"), b["before"].alias("before"),
                b["after"].alias("after")).alias("c"))
            for label, s in _rewritten(kind, b["s"])))))
        return F.filter(of, lambda r: F.coalesce(r["c"]["s"].rlike(f"^(?:{pattern})$"), F.lit(False)))

    found = F.transform(F.filter(F.concat("__number", "__spelt"), lambda c: ~c["known"] & _refused(c)), lambda c: F.struct(
        F.lit(0).alias("label"), F.struct(*(c[k].alias(k) for k in ("start", "stop", "s", "before", "after"))).alias("c")))
    return wide.select(F.col("__fold").alias("fold"), F.explode(F.concat(found, *map(made, ("email", "card", "phone")))).alias(
        "r")).select("fold", "r.label", "r.c")


def _forms(wide: DataFrame) -> DataFrame:
    """(fold, label, features, n): the lessons in ``wide``, equal ones counted."""
    features = _features(F.col("c"))
    lessons = _lessons(wide).select("fold", "label", *(f.of.alias(f.name) for f in features))
    return lessons.groupBy(*lessons.columns).agg(F.count("*").alias("n"))


def _fitted(wide: DataFrame) -> tuple[boosting.Boosted, float]:
    """Trees and calibrated threshold, learnt on the halves (column ``__fold``) of all texts, ``EXAMPLES`` among them."""
    rows = scratch.stage(_forms(wide), "pii-forms")
    names = [c for c in rows.columns if c not in ("fold", "label", "n")]
    trees = boosting.fit(rows.where("fold = 0"), names, "label", trees=20, depth=5, weight="n")
    scored = rows.where("fold = 1").select(
        "label", "n", (F.floor(trees.expression([F.col(n) for n in names]) * 1000) / 1000).alias("score"))
    curve = scored.groupBy("score").agg(F.sum(F.col("label") * F.col("n")).alias("valid"), F.sum("n").alias("n"))
    best, valid, n = PRECISION, 0, 0
    for r in curve.orderBy(F.desc("score")).collect():  # at most 1,001 rows: scores have three decimals
        valid, n = valid + r["valid"], n + r["n"]
        if valid + PRIOR_ROWS * r["score"] >= PRECISION * (n + PRIOR_ROWS) and r["score"] > 0.5:
            best = float(r["score"])
    return trees, best


def _named(kind: str, found: str) -> Column:
    return F.transform(found, lambda s: F.struct(
        F.lit(KINDS.index(kind)).alias("k"), s["start"].alias("start"), s["stop"].alias("stop")))


def _text_of(found: Column) -> Column:
    """kind:start:end of sorted (k, start, stop), joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(
        ":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _searched(docs: DataFrame, text: str, kept: list[str]) -> DataFrame:
    """Columns ``kept`` of ``docs``, the valid base spans of each kind and all wide candidates; ``__fold`` is a
    text's half.  Rows of ``EXAMPLES``, one in each half, are ``__made``: one plan searches them and the texts."""
    whole = F.col(text).cast("string")
    halves = docs.select(*kept, F.coalesce(whole, F.lit("")).alias("__t"), F.lit(False).alias("__made"),
                         F.abs(F.xxhash64(whole, F.lit(1)) % 2).cast("int").alias("__fold"))
    made = docs.sparkSession.range(0, 2, 1, 1).select(F.explode(F.array(*map(F.lit, EXAMPLES))).alias("__t"),
                                                      F.lit(True).alias("__made"), F.col("id").cast("int").alias("__fold"))
    return _candidates(_base(halves.unionByName(made, allowMissingColumns=True))).select(
        *kept, "__made", "__fold", *(f"__{k}" for k in (*KINDS, *WIDE)))


def _spans(docs: DataFrame, text: str, kept: list[str]) -> DataFrame:
    """Columns ``kept`` of ``docs`` with ``base`` and ``found``."""
    wide = scratch.stage(_searched(docs, text, kept), "pii-candidates")
    trees, least = _fitted(wide)
    wide = wide.where("NOT __made")
    base = wide.withColumn("base", F.array_sort(F.concat(*(_named(k, f"__{k}") for k in KINDS))))

    def kind(c: Column) -> Column:
        n = F.char_length(_digits(c["s"]))
        return (F.when(c["s"].rlike("(?i)at"), 0).when(n >= 13, F.when(
            (n > 15) | F.call_function("luhn_check", _digits(c["s"])), 2).otherwise(3))
            .when(c["s"].rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), 1).otherwise(3))

    # features are made once per candidate, not once per split
    scored = F.transform(F.filter(F.concat(*(f"__{k}" for k in WIDE)), lambda c: ~c["known"]), lambda c: F.struct(
        kind(c).alias("k"), c["start"].alias("start"), c["stop"].alias("stop"),
        F.array(*(f.of for f in _features(c))).alias("of")))
    added = F.transform(F.filter(scored, lambda c: trees.expression(c["of"]) >= F.lit(least)), lambda c: F.struct(
        *(c[k].alias(k) for k in ("k", "start", "stop"))))
    # only spelt candidates hold an "at": what is an address is spelt
    out = base.withColumn("__more", added).withColumns(
        {"__more_spelt": F.filter("__more", lambda c: c["k"] == 0), "__more_number": F.filter("__more", lambda c: c["k"] != 0)})
    # a number and a spelt address overlap only if the number lies within the address
    apart = F.filter("__more_number", lambda c: ~_overlaps(c, "__more_spelt"))
    out = out.withColumn("found", F.array_sort(F.concat("base", "__more_spelt", apart)))
    return out.select(*kept, "base", "found")


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``found``: sorted arrays of struct<k, start, stop>, k being
    the place in ``KINDS``; columns that bear these names are replaced."""
    return _spans(docs, text, [c for c in docs.columns if c not in ("base", "found")])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets, e.g. [EMAIL].
    Spans of different kinds that overlap become one, named by the first."""
    found = detect(docs, text)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    by_start = F.array_sort(F.transform("found", lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), s["k"].alias("k"))))
    reach = _running(F.transform("__by_start", lambda s: s["stop"]), F.greatest)

    def piece(start: Column, stop: Column) -> Column:
        """Characters of the text, found by way of the part of it that they lie in."""
        first = F.floor(start / PART).cast("int")
        parts = F.slice("__parts", first + 1, F.floor(stop / PART).cast("int") - first + 1)
        return F.substr(F.array_join(parts, ""), start - first * PART + 1, stop - start)

    def shown(s: Column, i: Column) -> Column:
        before = F.coalesce(F.get("__reach", i - 1), F.lit(0))
        name = F.element_at(names, s["k"] + 1)
        return F.when(s["start"] >= before, F.concat(piece(before, s["start"]), name)).otherwise("")

    some = F.size("found") > 0
    whole = F.col(text).cast("string")
    ready = found.withColumn("__by_start", by_start).withColumn("__reach", reach).withColumn(
        "__parts", F.when(some, F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{PART}}}+"), F.lit(0))))
    joined = F.concat(F.array_join(F.transform("__by_start", shown), ""),
                      piece(F.element_at("__reach", -1), F.char_length(whole)))
    return ready.withColumn(text, F.when(some, joined).otherwise(F.col(text))).select(*docs.columns)


def _of_kind(place: int) -> Column:
    return F.filter("base", lambda s: s["k"] == place)


def summary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base, spans): counts and lists of base spans and
    the list of all spans."""
    return _spans(docs, text, [key]).select(
        key,
        *(F.size(_of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)),
        _text_of(F.col("base")).alias("base"), _text_of(F.col("found")).alias("spans"))
