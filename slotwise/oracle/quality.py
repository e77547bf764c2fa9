"""Checks for the table checks: one plain statement per declared constraint."""

from __future__ import annotations

import re

from slotwise.oracle.tables import with_tables
from slotwise.queries import SPOILT, TWICE
from slotwise.sources.schemas import TABLES


def _union(parts: list[str], spoiled: bool) -> str:
    """One statement; if `spoiled`, on tables with broken rows in place of the plain ones."""
    text = "\nUNION ALL\n".join(parts)
    if not spoiled:
        return with_tables(text)
    steps = {}
    for name in {**SPOILT, **TWICE}:
        values = [f"{SPOILT.get(name, {}).get(f.name, f.name)} AS {f.name}" for f in TABLES[name].schema]
        rows = f"SELECT * FROM {name}"
        if name in TWICE:
            rows += f" UNION ALL SELECT * FROM {name} WHERE {TWICE[name]}"
        steps[f"spoiled_{name}"] = f"SELECT {', '.join(values)} FROM ({rows})"
        text = re.sub(rf"FROM {name}\b", f"FROM spoiled_{name}", text)
    return with_tables(text, **steps)


def _unique() -> list[str]:
    return [
        f"""SELECT '{t.name}' AS table_name, '{", ".join(keys)}' AS key_columns,
               count(*) AS duplicate_keys,
               CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows
        FROM (SELECT count(*) AS n FROM {t.name}
              WHERE {" OR ".join(f"{k} IS NOT NULL" for k in keys)}
              GROUP BY {", ".join(keys)} HAVING count(*) > 1)"""
        for t in TABLES.values()
        for keys in t.constraints
    ]


def _foreign_key() -> list[str]:
    return [
        f"""SELECT '{t.name}' AS table_name, '{column}' AS column_name,
               '{parent}' AS parent_table, count(*) AS orphan_rows
        FROM {t.name} c
        WHERE c.{column} IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = c.{column})"""
        for t in TABLES.values()
        for column, parent in t.links.items()
    ]


def _not_null() -> list[str]:
    return [
        f"""SELECT '{t.name}' AS table_name, '{column}' AS column_name,
               count(*) AS null_rows
        FROM {t.name} WHERE {column} IS NULL"""
        for t in TABLES.values()
        for column in t.required
    ]


def _domain() -> list[str]:
    parts = []
    for t in TABLES.values():
        rules = [(c, f"at most {n} digits", f"abs({c}) >= {10**n}") for c, n in t.digits.items()]
        rules += [
            (c, f"at most {n} characters", f"length({c}) > {n}") for c, n in t.lengths.items()
        ]
        parts += [
            f"""SELECT '{t.name}' AS table_name, '{c}' AS column_name, '{rule}' AS rule,
                   count(*) AS bad_rows
            FROM {t.name} WHERE {bad}"""
            for c, rule, bad in rules
        ]
    return parts


def _all() -> list[str]:
    """The four reports in one form."""
    columns = {
        "unique": (_unique, "key_columns", "''", "surplus_rows", "duplicate_keys"),
        "foreign key": (_foreign_key, "column_name", "parent_table", "orphan_rows", "0"),
        "not null": (_not_null, "column_name", "''", "null_rows", "0"),
        "domain": (_domain, "column_name", "rule", "bad_rows", "0"),
    }
    return [
        f"""SELECT table_name, '{kind}' AS kind, {subject} AS subject, {detail} AS detail,
                   {bad} AS bad_rows, CAST({keys} AS BIGINT) AS bad_keys FROM ({part})"""
        for kind, (report, subject, detail, bad, keys) in columns.items()
        for part in report()
    ]


def statements() -> dict[str, str]:
    reports = {
        "dq_unique": _unique(),
        "dq_foreign_key": _foreign_key(),
        "dq_not_null": _not_null(),
        "dq_domain": _domain(),
        "dq_all": _all(),
    }
    found = {name: _union(parts, False) for name, parts in reports.items()}
    found |= {f"{name}_spoiled": _union(parts, True) for name, parts in reports.items()}
    found["dq_kept_spoiled"] = found["dq_all_spoiled"]
    return found | {
        "duplicate_order_lines": """
            SELECT l_orderkey, l_linenumber, count(*) AS n_rows
            FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
        "orphan_requests": with_tables("""
            SELECT id_patient, count(*) AS n_rows FROM requests
            WHERE id_patient NOT IN (SELECT id FROM users) GROUP BY id_patient"""),
        "apply_defaults_missing_column": with_tables("""
            SELECT id, deleted_at, name, id_organization, CAST(0 AS INTEGER) AS status, id_type
            FROM hospitals"""),
        "apply_defaults_nulls": with_tables("""
            SELECT id, id_doctor_speciality, CASE WHEN closed = 1 THEN 1 ELSE 0 END AS closed,
                   time_begin, time_end
            FROM tickets"""),
    }
