"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '')"
_ASCII_LOWER = (f"translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

OP3 = """
WITH u AS (
    SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
), t AS (
    SELECT conv_id, alone, role, text, row_number() OVER (
        PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
    FROM u
), c AS (
    SELECT conv_id, count(*) AS n_turns,
           list({'r': role, 't': text} ORDER BY place) AS said,
           string_agg('<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, ''), chr(10) ORDER BY place) AS text
    FROM t GROUP BY conv_id, alone
), e AS (
    SELECT said, n_turns, min(conv_id) AS conv_id, count(*) AS copies, any_value(text) AS text FROM c GROUP BY said, n_turns
), p AS (
    SELECT DISTINCT said[1:k] AS said FROM (SELECT said, unnest(range(1, n_turns)) AS k FROM e)
)
SELECT conv_id, n_turns, copies, text FROM e WHERE said NOT IN (SELECT said FROM p)
"""

OP4 = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
    SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

OP6 = f"""
WITH d AS (
    SELECT doc_id, {_WORDS} AS w FROM documents
), o AS (
    SELECT doc_id, i, list_aggregate(w[i:i + 19], 'string_agg', ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), later AS (
    SELECT doc_id, i FROM o
    QUALIFY (doc_id, i) > first_value((doc_id, i)) OVER (PARTITION BY g ORDER BY doc_id, i)
), gone AS (
    SELECT doc_id, list(DISTINCT p) AS p
    FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later) GROUP BY doc_id
), k AS (
    SELECT d.doc_id, len(w) AS n_words, coalesce(len(p), 0) AS n_removed,
           CASE WHEN p IS NULL THEN w
                ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(p, i)), lambda i: w[i]) END AS kept
    FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(coalesce(list_aggregate(kept, 'string_agg', ' '), '')) AS kept_sha256
FROM k
"""

OP7 = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(regexp_split_to_array({_ASCII_LOWER}, '{_SPACE}'), lambda w: w <> '') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, list_aggregate(w[i:i + 2], 'string_agg', ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
    FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
    SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
    WHERE 100 * common >= 85 * (p.n + q.n - common)
), r(x, y) AS (
    SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), m AS (
    SELECT x, min(y) AS y FROM r GROUP BY x
), o AS (
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM o
"""

OP8 = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents
), l AS (
    SELECT r, source, text, ln, list_filter(regexp_split_to_array(ln, '{_SPACE}'), lambda x: x <> '') AS lw
    FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS ln FROM d)
), dup AS (
    SELECT r, sum(c - 1) AS n_dup_lines
    FROM (SELECT r, ln, count(*) AS c FROM l WHERE len(lw) > 0 GROUP BY r, ln) GROUP BY r
), g AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c
    FROM (SELECT r, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS t
          FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5))
), rep AS (
    SELECT r, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM g WHERE c > 1) GROUP BY r
), m AS (
    SELECT r, source, text, lower_ln, clean
    FROM (SELECT r, source, text,
                 translate(list_aggregate(lw, 'string_agg', ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS lower_ln,
                 len(list_filter(lw, lambda x: NOT regexp_matches(x, '[#*$%&|<>]'))) AS clean
          FROM l WHERE len(lw) > 0)
), hosts AS (
    SELECT source, count(DISTINCT text) AS texts FROM documents GROUP BY source
), freq AS (
    SELECT m.source, lower_ln FROM m GROUP BY m.source, lower_ln
    HAVING count(DISTINCT text) >= 20
       AND count(DISTINCT text) > 0.05 * (SELECT any_value(texts) FROM hosts h WHERE h.source IS NOT DISTINCT FROM m.source)
), verdict AS (
    SELECT r, sum(clean) FILTER (WHERE f.lower_ln IS NULL) AS remaining,
           count(*) FILTER (WHERE f.lower_ln IS NOT NULL) AS n_removed_lines
    FROM m LEFT JOIN freq f ON m.lower_ln = f.lower_ln AND m.source IS NOT DISTINCT FROM f.source GROUP BY r
), o AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
           CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words,
           coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(remaining, 0) AS remaining
    FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN verdict USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND remaining >= 0.25 * n_words AS kept,
       n_removed_lines
FROM o
"""

_BARE = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')".format(_ASCII_LOWER)

OP10 = f"""
WITH d AS (
    SELECT doc_id, {_BARE} AS w FROM documents
), b AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, {_BARE} AS w FROM benchmark
), q AS (
    SELECT DISTINCT item_id, len(w[i:i + 9]) AS n, list_aggregate(w[i:i + 9], 'string_agg', ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), o AS (
    SELECT doc_id, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g
    FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i
          FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)
), h AS (
    SELECT o.doc_id, o.i, o.n, q.item_id FROM o JOIN q ON o.g = q.g AND o.n = q.n
), words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def _climb(first: str, rows: str, levels: int, tag: str) -> str:
    """CTEs that grow trees from ``first`` (tree, i, h) and carry ``rows`` (tree, place, f, proof, ...)
    up with them: {tag}n{levels} has the trees' last nodes, {tag}p{levels} the carried rows."""
    out = [f"{tag}n0 AS (SELECT tree, i, h FROM {first})", f"{tag}p0 AS (SELECT * FROM {rows})"]
    for k in range(levels):
        out += [f"""{tag}r{k} AS (
    SELECT tree, i // 8 AS j, list(h ORDER BY i) AS kids, any_value(n) AS n
    FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {tag}n{k}) GROUP BY tree, i // 8
)""", f"""{tag}n{k + 1} AS (
    SELECT tree, j AS i, CASE WHEN n = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS h FROM {tag}r{k}
)""", f"""{tag}p{k + 1} AS (
    SELECT * EXCLUDE (f, proof, n, l, r), CASE WHEN n = 1 THEN f ELSE sha256(l || f || r) END AS f,
           CASE WHEN n = 1 THEN proof ELSE proof || l || r END AS proof
    FROM (SELECT p.*, n, array_to_string(kids[1:(place // {8 ** k}) % 8], '') AS l,
                 array_to_string(kids[(place // {8 ** k}) % 8 + 2:], '') AS r
          FROM {tag}p{k} p JOIN {tag}r{k} q ON p.tree = q.tree AND p.place // {8 ** (k + 1)} = q.j)
)"""]
    return ", ".join(out)


def _part(column: str, value: str | None = None) -> str:
    value = value or f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"


_HEAD = " || ".join(map(_part, ("doc_id", "source", "lang", "n_chars")))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC_STEPS = "list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, {})"
_CRC = (f"xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
        f"lambda x: CAST(ascii(x) AS BIGINT)), lambda s, b: {_CRC_STEPS.format('xor(s, b)')}, 4294967295))")

OP13 = f"""
WITH d AS (
    SELECT doc_id, coalesce('=' || lang, '') AS lang, sha256({_HEAD} || {_part('text')}) AS leaf,
           CASE WHEN {_CRC} % 3 = 0 THEN sha256({_HEAD} || {_part('text', _LOWER)}) END AS changed
    FROM documents
), o AS (
    SELECT doc_id, lang AS tree, leaf, coalesce(changed, leaf) AS f, '' AS proof,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
    FROM d
), w AS (
    SELECT tree, place AS i, leaf AS h FROM o
), {_climb("w", "o", 8, "a")}, s AS (
    SELECT '' AS tree, tree AS lang, h AS subroot, h, row_number() OVER (ORDER BY tree) - 1 AS i FROM an8
), t AS (
    SELECT '' AS tree, s.i AS place, f, proof, doc_id, leaf, subroot FROM ap8 JOIN s ON ap8.tree = s.lang
), {_climb("s", "t", 4, "b")}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified
FROM bp4 JOIN bn4 USING (tree)
"""

ORACLES: dict[str, str] = {
    "op3_chat": OP3,
    "op4_warc": OP4,
    "op6_substring_dedup": OP6,
    "op7_minhash": OP7,
    "op8_quality": OP8,
    "op10_decontamination": OP10,
    "op13_manifest": OP13,
}
