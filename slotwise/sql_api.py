"""The reads as SQL table functions with default and named arguments.

    register(spark, clinic)
    spark.sql("SELECT * FROM get_towns_by_region(p_id_region => 3)")

Functions that depend on the time take `as_of`, by default the current time. A parameter
that is null equates its column with itself, which the optimizer folds to no filter; any
other value becomes a filter that reaches the scan. Functions with a single parameter for
a key also serve each row of a table, `FROM doctors d, LATERAL get_tickets_by_doctor(d.id)`:
one branch of their union takes the rows of a given key and one all rows for a null one, so
that both become equi-joins. With a constant one branch folds away. A body's ORDER BY does not bind the outer
query, so the two sorted reads give their sort keys as columns of the result: order by
`sort_1`, `sort_2`, `sort_3` and the id.

Four reads whose rule is described otherwise than it is written have a second function whose
name ends in `_intended`. Its sort keys are to be taken in descending order.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from slotwise.operators import reads
from slotwise.sources.clinic import SLOT_MONTH, Clinic
from slotwise.sources.schemas import TABLES

_DOCTORS = """SELECT *, {sign}degree,
              coalesce(area = nullif(p_area, ''), nullif(p_area, '') IS NULL) FROM live_doctors
              WHERE id_hospital <=> coalesce(p_id_hospital, id_hospital)"""
_DOCUMENTS = """SELECT * FROM patient_documents WHERE {key} = p_id_patient
                AND id_document_type <=> coalesce(p_id_document_type, id_document_type)"""
_CLOCK = "as_of TIMESTAMP_NTZ DEFAULT localtimestamp()"


def _columns(table: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES[table].schema)


def _of(parameter: str, column: str, table: str) -> str:
    """Rows of `table` whose `column` is the parameter; all rows where that is null."""
    names = ", ".join(f.name for f in TABLES[table].schema)
    return f"""SELECT {names} FROM {table} WHERE {column} = {parameter}
               UNION ALL
               SELECT {names} FROM (SELECT *, nullif({column}, {column}) AS none FROM {table})
               WHERE none <=> {parameter} AND {parameter} IS NULL"""


def _tickets() -> str:
    names = ", ".join(f.name for f in TABLES["tickets"].schema)
    return f"""SELECT {names} FROM (
                 SELECT t.*, l.id_doctor FROM tickets t
                 JOIN doctor_specialty l ON l.id = t.id_doctor_speciality)
               WHERE id_doctor = filter_id_doctor AND time_begin > as_of
               UNION ALL
               SELECT {names} FROM (SELECT *, nullif(id, id) AS none FROM tickets)
               WHERE none <=> filter_id_doctor AND filter_id_doctor IS NULL
                 AND time_begin > as_of"""


def _functions() -> dict[str, tuple[str, str, str]]:
    """Name -> (parameters, result columns, body)."""
    return {
        "get_towns_by_region": (
            "p_id_region BIGINT DEFAULT NULL",
            _columns("towns"),
            _of("p_id_region", "id_region", "towns"),
        ),
        "get_doctors_by_specialty": (
            "p_age_group BIGINT DEFAULT NULL",
            _columns("specialities"),
            """SELECT * FROM specialities_with_doctors
               WHERE id_age_group <=> coalesce(p_age_group, id_age_group)""",
        ),
        "get_hospitals_by_speciality": (
            "p_id_specialty BIGINT DEFAULT NULL, p_hospital_status INT DEFAULT NULL, " + _CLOCK,
            "id BIGINT, id_type BIGINT, name STRING, id_organization BIGINT, status INT, "
            "doc_count BIGINT, sort_1 BOOLEAN, sort_2 BIGINT, sort_3 STRING",
            """WITH staff AS (
                 SELECT d.id_hospital, count(*) AS links
                 FROM doctors d JOIN doctor_specialty l ON l.id_doctor = d.id
                 WHERE l.id_speciality <=> coalesce(p_id_specialty, l.id_speciality)
                 GROUP BY d.id_hospital),
               hours AS (
                 SELECT id_hospital, end_time, count(*) AS days
                 FROM hospital_work_times WHERE end_time > date_format(as_of, 'HH:mm')
                 GROUP BY id_hospital, end_time)
               SELECT h.id, h.id_type, h.name, h.id_organization, h.status,
                      links * days, h.id_type = 1, -links * days, end_time
               FROM live_hospitals h
               JOIN staff USING (id_hospital) JOIN hours USING (id_hospital)
               WHERE h.status <=> coalesce(p_hospital_status, h.status)""",
        ),
        "get_doctors_by_hospital": (
            "p_id_hospital BIGINT DEFAULT NULL, p_area STRING DEFAULT NULL",
            _columns("doctors") + ", sort_1 INT, sort_2 BOOLEAN",
            _DOCTORS.format(sign="-"),
        ),
        "get_tickets_by_doctor": (
            "filter_id_doctor BIGINT DEFAULT NULL, " + _CLOCK,
            _columns("tickets"),
            _tickets(),
        ),
        "get_documents_by_patient": (
            "p_id_patient BIGINT, p_id_document_type BIGINT DEFAULT NULL",
            _columns("patient_documents"),
            _DOCUMENTS.format(key="id"),
        ),
        "get_hospitals_work_time": (
            "p_id_hospital BIGINT DEFAULT NULL, p_id_week_day INT DEFAULT NULL",
            _columns("hospital_work_times"),
            """SELECT * FROM hospital_work_times
               WHERE id_hospital <=> coalesce(p_id_hospital, id_hospital)
                 AND id_week_day <=> coalesce(p_id_week_day, id_week_day)""",
        ),
        "get_patient_journald_by_patient_id": (
            "p_id_patient BIGINT DEFAULT NULL",
            _columns("patient_journals"),
            _of("p_id_patient", "id_patient", "patient_journals"),
        ),
    }


def _intended() -> dict[str, tuple[str, str, str]]:
    """The functions by the rules as described, in the form of `_functions`."""
    plain = _functions()
    parameters = {name: given for name, (given, _, _) in plain.items()}
    columns = {name: found for name, (_, found, _) in plain.items()}
    specialities, hospitals = "get_doctors_by_specialty", "get_hospitals_by_speciality"
    doctors, documents = "get_doctors_by_hospital", "get_documents_by_patient"
    return {
        f"{specialities}_intended": (
            parameters[specialities],
            columns[specialities],
            """SELECT * FROM specialities_with_doctors_intended
               WHERE id_age_group <=> coalesce(p_age_group, id_age_group)""",
        ),
        f"{hospitals}_intended": (
            parameters[hospitals] + ", p_week_start INT DEFAULT 1",
            "id BIGINT, id_type BIGINT, name STRING, id_organization BIGINT, status INT, "
            "available BOOLEAN, doc_count BIGINT, end_time STRING, open_now BOOLEAN, "
            "sort_1 BOOLEAN, sort_2 BIGINT, sort_3 BOOLEAN",
            """WITH links AS (
                 SELECT id_doctor FROM doctor_specialty LEFT SEMI JOIN live_specialities
                 USING (id_speciality)
                 WHERE id_speciality <=> coalesce(p_id_specialty, id_speciality)),
               staff AS (
                 SELECT id_hospital, count(*) AS n
                 FROM (SELECT *, id AS id_doctor FROM live_doctors) LEFT SEMI JOIN links
                 USING (id_doctor) GROUP BY id_hospital),
               hours AS (
                 SELECT id_hospital, end_time,
                        coalesce(end_time > date_format(as_of, 'HH:mm'), false) AS open_now
                 FROM hospital_work_times
                 WHERE id_week_day = pmod(weekday(as_of) + 1 - p_week_start, 7) + 1)
               SELECT h.id, h.id_type, h.name, h.id_organization, h.status, h.status <> 0, n,
                      end_time, coalesce(open_now, false), h.id_type = 1, n,
                      coalesce(open_now, false)
               FROM live_hospitals h
               JOIN staff USING (id_hospital) LEFT JOIN hours USING (id_hospital)
               WHERE h.status <=> coalesce(p_hospital_status, h.status)""",
        ),
        f"{doctors}_intended": (
            parameters[doctors], columns[doctors], _DOCTORS.format(sign="")
        ),
        f"{documents}_intended": (
            parameters[documents], columns[documents], _DOCUMENTS.format(key="id_patient")
        ),
    }


def register(spark: SparkSession, clinic: Clinic) -> list[str]:
    """Temporary views of all tables and the functions over them; returns their names."""
    for name in TABLES:
        if name in clinic.names():
            getattr(clinic, name).drop(SLOT_MONTH).createOrReplaceTempView(name)
    hospitals = reads.live(clinic.hospitals)
    hospitals.withColumn("id_hospital", hospitals["id"]).createOrReplaceTempView(
        "live_hospitals"
    )
    reads.live(clinic.doctors).createOrReplaceTempView("live_doctors")
    specialities = reads.live(clinic.specialities).select(F.col("id").alias("id_speciality"))
    specialities.createOrReplaceTempView("live_specialities")
    reads.specialities_with_doctors(clinic).createOrReplaceTempView(
        "specialities_with_doctors"
    )
    reads.specialities_with_doctors(clinic, semantics="intended").createOrReplaceTempView(
        "specialities_with_doctors_intended"
    )
    functions = _functions() | _intended()
    for name, (parameters, columns, body) in functions.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) "
            f"RETURNS TABLE({columns}) RETURN {body}"
        )
    return list(functions)
