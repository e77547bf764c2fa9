"""Secret scans through an inverted index of the trigrams that the rules ask for.

All of it is DataFrame functions. A rule's pattern is turned into a Boolean query over
trigrams; the index has a posting (trigram, content) for each trigram that some query asks
for; the postings are intersected per rule; only contents that stay are matched. Rules whose
pattern has no mandatory trigram are matched on all texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as tokens
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


@dataclass(frozen=True)
class Rule:
    """`pattern` holds for Java and for Python. Of a match, the characters of `group` must be
    `least` or more; matches that are shorter are dropped without a retry. `scan` is a form
    of the pattern with the same kept matches that is faster on whole texts."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    scan: str | None = None


# The base rules and their limits, then public token formats.
BASE = (
    Rule(
        "assign",
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        6,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    # A run of 24 or more is found at its first character, as the whole run is.
    Rule("hex", r"[0-9a-f]+", 24, scan=r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 36),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
)
RULES = BASE + ADDED


# ---- trigram queries -----------------------------------------------------------------


def _strings(node) -> list[set[str] | None]:
    """The pattern as a row of parts: a set of strings one of which stands there, in lower
    case, or None for a part that may be anything."""
    op, arg = node
    if op is tokens.LITERAL:
        return [{chr(arg).lower()}]
    if op is tokens.IN and len(arg) <= 8 and all(o is tokens.LITERAL for o, _ in arg):
        return [{chr(c).lower() for _, c in arg}]
    if op is tokens.SUBPATTERN:
        return _row(arg[3])
    if op is tokens.BRANCH:
        rows = [_row(branch) for branch in arg[1]]
        if all(len(row) == 1 and row[0] is not None for row in rows):
            return [set().union(*(row[0] for row in rows))]
        return [None]
    if op in (tokens.MAX_REPEAT, tokens.MIN_REPEAT):
        low, high, inner = arg
        row = _row(inner)
        one = row[0] if len(row) == 1 else None
        if one is not None and (low, high) == (0, 1):
            return [one | {""}]
        if one is not None and len(one) == 1:
            return [{next(iter(one)) * int(low)}, *([] if low == high else [None])]
        return [None]
    return [None]


def _row(nodes) -> list[set[str] | None]:
    row: list[set[str] | None] = []
    for node in nodes:
        for part in _strings(node):
            if part is not None and row and row[-1] is not None and len(row[-1]) * len(part) <= 64:
                row[-1] = {a + b for a, b in product(row[-1], part)}
            else:
                row.append(part)
    return row


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """An AND of ORs of ANDs of trigrams that each match has, in lower case.

    Empty where no trigram is mandatory.
    """
    query = []
    for part in _row(parser.parse(pattern)):
        if part and all(len(s) >= 3 for s in part):
            query.append(sorted(sorted({s[i : i + 3] for i in range(len(s) - 2)}) for s in part))
    return query


def _holds(query: list[list[list[str]]], found: Column) -> Column:
    """Whether a content whose trigrams are the array `found` satisfies the query."""
    result = F.lit(True)
    for either in query:
        one = F.lit(False)
        for every in either:
            wanted = F.array(*map(F.lit, every))
            one = one | (F.size(F.array_intersect(found, wanted)) == len(every))
        result = result & one
    return result


def trigram_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (gram, _key) of the given trigrams over `docs` (_key, _text), stored.

    Each distinct content has one posting per trigram; copies are combined in the scan.
    """
    held = [F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams]
    low = docs.select("_key", F.lower("_text").alias("_low"))
    found = low.select("_key", F.array_compact(F.array(*held)).alias("_grams"))
    rows = found.select("_key", F.explode("_grams").alias("gram"))
    return stored(rows.distinct(), "trigrams")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(_key, _rules): the rules whose query the postings of a content satisfy."""
    lists = index.groupBy("_key").agg(F.collect_set("gram").alias("_found"))
    named = [
        F.when(_holds(trigram_query(r.pattern), F.col("_found")), F.lit(r.kind)) for r in rules
    ]
    kept = lists.select("_key", F.array_compact(F.array(*named)).alias("_rules"))
    return kept.filter(F.size("_rules") > 0)


# ---- matches ---------------------------------------------------------------------------


def _spans(rule: Rule, text: Column) -> Column:
    """Array of (start, end, kind) of the kept matches, in code points, in order.

    The texts between the matches and the matches themselves, both in order, give the places.
    """
    pattern = rule.scan or rule.pattern
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.length)
    # The outer group shifts the pattern's own groups by one.
    part = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(rule.group + 1))
    triples = F.arrays_zip(
        F.slice(between, F.lit(1), F.size(whole)).alias("gap"),
        whole.alias("size"),
        F.transform(part, F.length).alias("least"),
    )
    empty = "struct(0L AS at, CAST(array() AS array<struct<start:bigint,end:bigint,kind:string>>) AS found)"
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["size"]).cast("long").alias("at"),
        F.when(
            x["least"] >= rule.least,
            F.concat(
                acc["found"],
                F.array(
                    F.struct(
                        (acc["at"] + x["gap"]).cast("long").alias("start"),
                        (acc["at"] + x["gap"] + x["size"]).cast("long").alias("end"),
                        F.lit(rule.kind).alias("kind"),
                    )
                ),
            ),
        )
        .otherwise(acc["found"])
        .alias("found"),
    )
    return F.aggregate(triples, F.expr(empty), step, lambda acc: acc["found"])


def find_secrets(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
) -> DataFrame:
    """`docs` with `secrets`, an array of (start, end, kind) by start, then order of rules.

    start and end count code points, end exclusive. Contents are known by their digest, so
    copies of a text, rows with null ids and repeated rows are all handled alike; null texts
    are empty and have no spans; an empty table gives an empty result; a column of `docs`
    named secrets is replaced.
    """
    none = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint,kind:string>>)")
    asked = tuple(r for r in rules if trigram_query(r.pattern))
    grams = sorted({g for r in asked for either in trigram_query(r.pattern) for every in either for g in every})
    keyed = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    keyed = keyed.withColumn("_key", F.sha2("_text", 256))
    arrays = []
    if asked:
        found = candidates(trigram_index(keyed.select("_key", "_text"), grams), asked)
        keyed = keyed.join(found, "_key", "left")
    for rule in rules:
        if rule in asked:
            scanned = F.array_contains("_rules", rule.kind)
        else:
            scanned = F.col("_text").rlike(rule.scan or rule.pattern)
        arrays.append(F.when(scanned, _spans(rule, F.col("_text"))).otherwise(none))
    order = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)))
    ranked = F.transform(
        F.concat(*arrays),
        lambda s: F.struct(s["start"], F.element_at(order, s["kind"]).alias("k"), s["end"], s["kind"]),
    )
    plain = F.transform(
        F.array_sort(ranked), lambda s: F.struct(s["start"], s["end"], s["kind"])
    )
    keyed = keyed.withColumn("secrets", plain)
    return keyed.drop("_key", "_text", "_rules")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
