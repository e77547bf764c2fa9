"""The domain tables as DuckDB common table expressions over the star-schema views."""

from __future__ import annotations

import re

from slotwise.sources.lookups import LOOKUPS, values_sql
from slotwise.sources.schemas import LOG, REQUESTS, TABLES

_DELETED = "CASE WHEN {when} THEN make_timestamp(2019, ({n} % 11 + 1)::BIGINT, 1, 0, 0, 0) END"

_STAR = {
    "regions": """
        SELECT r_regionkey AS id, r_name AS name, r_regionkey + 1 AS code FROM region""",
    "towns": """
        SELECT n_nationkey AS id, n_name AS name, n_regionkey AS id_region FROM nation""",
    "organizations": """
        SELECT s_suppkey AS id, s_name AS name, s_nationkey AS id_town FROM supplier""",
    "hospitals": f"""
        SELECT id, {_DELETED.format(when="id * 7 % 10 < 4", n="id")} AS deleted_at,
               s_name || ' hospital ' || (k + 1) AS name, s_suppkey AS id_organization,
               id % 10 AS status, id % 2 + 1 AS id_type
        FROM (SELECT *, s_suppkey * 3 + k AS id
              FROM supplier, generate_series(0, 2) AS g(k))""",
    "hospital_work_times": """
        SELECT h * 7 + w AS id, w AS id_week_day, h AS id_hospital,
               '0' || ((h + w) % 3 + 6) || ':00' AS begin_time,
               (h * w % 3 + 16) || ':00' AS end_time
        FROM (SELECT s_suppkey * 3 + k AS h
              FROM supplier, generate_series(0, 2) AS g(k)), generate_series(1, 7) AS d(w)""",
    "doctors": f"""
        SELECT p_partkey AS id,
               {_DELETED.format(when="p_partkey % 3 = 0", n="p_partkey")} AS deleted_at,
               'area ' || (p_partkey % 5 + 1) AS area, p_size AS degree,
               p_type AS qualification, p_retailprice AS salary,
               p_partkey % (3 * (SELECT count(*) FROM supplier)) AS id_hospital
        FROM part""",
    "doctors_reviews": """
        SELECT conv_id * 100 + turn AS id,
               (conv_id * 8 + turn) % (SELECT count(*) FROM part) AS id_doctor,
               text AS review, (conv_id + turn) % 10 AS rate
        FROM conversations""",
    "specialities": f"""
        SELECT p_partkey AS id,
               {_DELETED.format(when="p_partkey // 4 % 3 = 0", n="p_partkey")} AS deleted_at,
               p_partkey // 4 % 5 + 1 AS id_age_group
        FROM part""",
    "doctor_specialty": """
        SELECT p_partkey * 3 + j AS id,
               (p_partkey * 5 + j * 7) % (SELECT count(*) FROM part) AS id_speciality,
               p_partkey AS id_doctor
        FROM part, generate_series(0, 2) AS g(j)""",
    "speciality_gender": """
        SELECT p_partkey AS id_speciality, i * 2 + 2 - p_partkey // 4 % 2 AS id_gender
        FROM part, generate_series(0, 1) AS g(i)""",
    "users": """
        SELECT id, 'user ' || id AS name, 'user' || id || '@clinic.example' AS email,
               'dummy' AS password
        FROM (SELECT DISTINCT c_custkey - c_custkey % 5 AS id FROM customer)""",
    "patients": """
        SELECT c_custkey AS id, c_custkey - c_custkey % 5 AS id_user,
               c_name AS first_name, c_mktsegment AS last_name, NULL AS patronymic,
               make_date(c_custkey * 37 % 81 + 1918, 6, 1) AS birthdate,
               c_custkey % 4 + 1 AS id_gender, c_custkey + 70000000000 AS phone,
               'area ' || (c_custkey % 47 + 1) AS area
        FROM customer""",
    "patient_documents": """
        SELECT c_custkey * 2 + j AS id, 'document ' || (c_custkey * 2 + j) AS name,
               c_custkey AS id_patient, 'file' || (c_custkey * 2 + j) AS file_name,
               NULL AS content,
               CASE WHEN j = 0 AND c_custkey % 3 = 0 THEN 1
                    WHEN j = 0 THEN 4
                    WHEN c_custkey % 5 = 0 THEN 4
                    ELSE 2 END AS id_document_type
        FROM customer, generate_series(0, 1) AS g(j)""",
    "tickets": """
        SELECT o * 8 + n AS id, p * 3 + n % 3 AS id_doctor_speciality,
               CASE WHEN status = 'F' THEN 1 ELSE 0 END AS closed,
               day + to_hours(10) + to_minutes(30 * ((o + n) % 20)) AS time_begin,
               day + to_hours(10) + to_minutes(30 * ((o + n) % 20) + 30) AS time_end
        FROM (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p,
                     min(l_linestatus) AS status, min(l_shipdate) AS day
              FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "patient_journals": """
        SELECT o_custkey AS id_patient, o * 8 + n AS id_ticket,
               CASE WHEN status = 'F' THEN 0 ELSE 1 END AS status
        FROM (SELECT l_orderkey AS o, l_linenumber AS n, min(l_linestatus) AS status,
                     min(l_returnflag) AS flag
              FROM lineitem GROUP BY l_orderkey, l_linenumber)
        JOIN orders ON o_orderkey = o
        WHERE status = 'F' OR flag = 'R'""",
    "requests": """
        SELECT id * 8 + k AS seq,
               (id * 7 + 4 * k) % (SELECT count(*) FROM customer) AS id_patient,
               id AS id_ticket
        FROM tickets, generate_series(0, 2) AS g(k)
        UNION ALL
        SELECT id_ticket * 8 + 4, id_patient, id_ticket
        FROM patient_journals WHERE status = 1""",
    "cancels": """
        SELECT id_ticket * 2 + k AS seq, id_patient, id_ticket
        FROM patient_journals, generate_series(0, 1) AS g(k)""",
    "booking_log": """
        SELECT id * 16 + place AS seq, op,
               (id * 7 + 4 * k) % (SELECT count(*) FROM customer) AS id_patient,
               id AS id_ticket
        FROM tickets, (VALUES (0, 'request', 0), (2, 'request', 1), (3, 'cancel', 0),
                              (4, 'request', 2), (13, 'request', 1)) AS c(place, op, k)
        UNION ALL
        SELECT id_ticket * 16 + place, op, id_patient, id_ticket
        FROM patient_journals,
             (VALUES (5, 'cancel'), (8, 'request'), (11, 'cancel')) AS c(place, op)""",
}

_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "binary": "BLOB",
}


def _typed(name: str, body: str) -> str:
    inputs = {"requests": REQUESTS, "cancels": REQUESTS, "booking_log": LOG}
    schema = inputs.get(name) or TABLES[name].schema
    columns = []
    for field in schema:
        text = field.dataType.simpleString()
        columns.append(f"CAST({field.name} AS {_TYPES.get(text, text)}) AS {field.name}")
    return f"SELECT {', '.join(columns)} FROM ({body.strip()})"


CTES = {n: _typed(n, values_sql(n)) for n in LOOKUPS}
CTES |= {n: _typed(n, body) for n, body in _STAR.items()}


ONCE = {"requests", "cancels", "booking_log", "matches", "able", "winners"}


def with_tables(query: str, recursive: bool = False, **steps: str) -> str:
    """Prefix `query` with the tables it names, then with its own `steps` in order."""
    text = " ".join([query, *steps.values()])
    needed: list[str] = []

    def need(body: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", body):
                if name in _STAR:
                    need(_STAR[name])
                if name not in needed:
                    needed.append(name)

    need(text)
    # What is used more than once is worked out once, whatever the optimiser would do.
    def once(name: str) -> str:
        return "MATERIALIZED " if name in ONCE else ""

    parts = [f"{n} AS {once(n)}({CTES[n]})" for n in needed]
    parts += [f"{n} AS {once(n)}({body.strip()})" for n, body in steps.items()]
    lead = "WITH RECURSIVE " if recursive else "WITH "
    return lead + ",\n".join(parts) + "\n" + query.strip() if parts else query
