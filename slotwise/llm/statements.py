"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .secrets import BASE, RULES

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{_WORD}')"


DECONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
pieces AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS k,
           array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM pieces),
runs AS (
    SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lengths WHERE len(w) >= k)),
hits AS MATERIALIZED (SELECT r, i, k, item_id FROM runs JOIN pieces USING (k, phrase)),
covered AS (
    SELECT r, count(DISTINCT p) AS n_hit
    FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
items AS (
    SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)"""


def _secrets() -> str:
    found = []
    for order, rule in enumerate(RULES):
        pattern = (rule.scan or rule.pattern).replace("(?i:(", "((?i)").replace("))[", ")[")
        pattern = pattern.replace("'", "''")
        found.append(f"""
    SELECT r, {order} AS o, '{rule.kind}' AS kind, unnest(gaps[:len(sizes)]) AS gap, unnest(sizes) AS size,
           unnest(least) AS least, {rule.least} AS most, unnest(range(len(sizes))) AS i
    FROM (SELECT r, list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS gaps,
                 list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) AS sizes,
                 list_transform(regexp_extract_all(t, '{pattern}', {rule.group}), lambda x: length(x)) AS least
          FROM d)""")
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    joined = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o)"
    counts = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)
    sums = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(found)}),
placed AS (
    SELECT *, sum(gap + size) OVER (PARTITION BY r, o ORDER BY i) AS b FROM raw),
kept AS (
    SELECT r, o, kind, CAST(b - size AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM placed WHERE least >= most),
each AS (
    SELECT r, {sums}, {joined} AS spans, {joined} FILTER (kind IN ({base})) AS own FROM kept GROUP BY r)
SELECT doc_id, {counts}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN each USING (r)"""


def _leaf(n_chars: str) -> str:
    columns = ("doc_id", "source", "lang", n_chars, "text")
    fields = (f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)
    return f"sha256({' || '.join(fields)})"


def _levels(name: str, leaves: str, key: str) -> str:
    """All levels of the trees over `leaves` ({key}, n, i, h), one for each {key}."""
    return f"""
{name} AS (
    SELECT {key}, 0 AS level, n, i, h FROM {leaves}
    UNION ALL
    SELECT {key}, level + 1, (n + 1) // 2, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name}
    WHERE n > 1 GROUP BY {key}, level, n, i // 2)"""


# Row numbers stand for ids, which may repeat. The checksum is taken bit by bit; proofs climb
# with the digest of the row as claimed beside them.
MERKLE = f"""
WITH RECURSIVE d AS MATERIALIZED (
    SELECT *, {_leaf("n_chars")} AS own,
           CASE WHEN doc_id IS NOT NULL AND xor(4294967295, list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(
                   range(1, length(CAST(doc_id AS VARCHAR)) + 1),
                   lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), k, 1)) AS BIGINT))),
               lambda c, b: list_reduce(
                   list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                   lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) % 7 = 0
           THEN {_leaf("n_chars + 1")} ELSE own END AS claimed
    FROM documents),
leaves AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, own) - 1 AS i,
           count(*) OVER (PARTITION BY lang) AS n, own AS h, coalesce('=' || lang, '') AS tree
    FROM d),
{_levels("nodes", "leaves", "tree")},
subroots AS (
    SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n, 0 AS top
    FROM nodes WHERE n = 1),
{_levels("upper", "subroots", "top")},
whole AS (SELECT tree, level, n, i, h FROM nodes),
climb AS (
    SELECT tree, i AS leaf_i, 0 AS level, i, claimed AS h, '' AS proof FROM leaves
    UNION ALL
    SELECT c.tree, leaf_i, c.level + 1, c.i // 2,
           sha256(CASE WHEN c.i % 2 = 1 THEN coalesce(s.h, '') || c.h ELSE c.h || coalesce(s.h, '') END),
           proof || coalesce(s.h, '')
    FROM climb c JOIN whole o ON o.tree = c.tree AND o.level = c.level AND o.i = c.i AND o.n > 1
    LEFT JOIN whole s ON s.tree = c.tree AND s.level = c.level AND s.i = xor(c.i, 1)),
below AS (SELECT tree, leaf_i, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM climb GROUP BY ALL),
above AS (
    SELECT tree, leaf_i, 0 AS level, s.i, b.h, proof FROM below b JOIN subroots s USING (tree)
    UNION ALL
    SELECT c.tree, leaf_i, c.level + 1, c.i // 2,
           sha256(CASE WHEN c.i % 2 = 1 THEN coalesce(s.h, '') || c.h ELSE c.h || coalesce(s.h, '') END),
           proof || coalesce(s.h, '')
    FROM above c JOIN upper o ON o.level = c.level AND o.i = c.i AND o.n > 1
    LEFT JOIN upper s ON s.level = c.level AND s.i = xor(c.i, 1)),
done AS (SELECT tree, leaf_i, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM above GROUP BY ALL)
SELECT doc_id, own AS leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256,
       done.h AS folded_root, done.h = r.h AS verified
FROM leaves l JOIN done ON done.tree = l.tree AND leaf_i = l.i JOIN subroots s ON s.tree = l.tree
JOIN upper r ON r.n = 1"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": DECONTAMINATION, "op8_secrets": _secrets(), "op11_merkle": MERKLE}
