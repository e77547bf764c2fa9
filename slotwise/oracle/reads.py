"""Checks for the reads: the plain joins, counted and numbered the direct way."""

from __future__ import annotations

from slotwise.oracle.tables import with_tables

NOON = "TIMESTAMP '1998-06-15 14:30:00'"
EVENING = "16:30"  # clock text of the moment used for opening hours, a Monday

_SPECIALITY_ROWS = """
    FROM specialities s
    JOIN doctor_specialty ds ON ds.id_speciality = s.id
    JOIN doctors d ON d.id = ds.id_doctor AND d.deleted_at IS NULL
    JOIN hospitals h ON h.id = d.id_hospital AND h.deleted_at IS NULL
    WHERE s.deleted_at IS {null} {extra}"""


def _specialities(semantics: str, extra: str = "") -> str:
    if semantics == "literal":
        return "SELECT s.* " + _SPECIALITY_ROWS.format(null="NOT NULL", extra=extra)
    return "SELECT DISTINCT s.* " + _SPECIALITY_ROWS.format(null="NULL", extra=extra)


def _hospitals_literal(where: str, pos: str) -> str:
    return f"""
    SELECT h.id, h.id_type, h.name, h.id_organization, h.status, count(d.id) AS doc_count
           {pos}
    FROM hospitals h
    JOIN doctors d ON d.id_hospital = h.id
    JOIN doctor_specialty ds ON ds.id_doctor = d.id
    JOIN specialities s ON s.id = ds.id_speciality
    JOIN hospital_work_times t ON t.id_hospital = h.id
    WHERE h.deleted_at IS NULL AND t.end_time > '{EVENING}' {where}
    GROUP BY h.id, h.id_type, h.name, h.id_organization, h.status, t.end_time"""


def _hospitals_intended(where_hospital: str, where_link: str, pos: str, day: int = 1) -> str:
    return f"""
    SELECT h.id, h.id_type, h.name, h.id_organization, h.status, h.status <> 0 AS available,
           count(DISTINCT d.id) AS doc_count, any_value(t.end_time) AS end_time,
           coalesce(any_value(t.end_time) > '{EVENING}', FALSE) AS open_now {pos}
    FROM hospitals h
    JOIN doctors d ON d.id_hospital = h.id AND d.deleted_at IS NULL
    JOIN doctor_specialty ds ON ds.id_doctor = d.id
    JOIN specialities s ON s.id = ds.id_speciality AND s.deleted_at IS NULL {where_link}
    LEFT JOIN hospital_work_times t ON t.id_hospital = h.id AND t.id_week_day = {day}
    WHERE h.deleted_at IS NULL {where_hospital}
    GROUP BY h.id, h.id_type, h.name, h.id_organization, h.status"""


_POS_LITERAL = """, row_number() OVER (ORDER BY (h.id_type = 1)::INT, count(d.id) DESC,
                                       t.end_time DESC, h.id) AS pos"""
_POS_INTENDED = f"""
    , row_number() OVER (ORDER BY (h.id_type = 1)::INT DESC, count(DISTINCT d.id) DESC,
          coalesce(any_value(t.end_time) > '{EVENING}', FALSE)::INT DESC, h.id) AS pos"""


def _doctors(match_order: str, hospital: str = "") -> str:
    return f"""
    SELECT d.*, row_number() OVER (
               PARTITION BY h.id
               ORDER BY d.degree DESC, (d.area = 'area 2')::INT {match_order}, d.id) AS pos
    FROM doctors d JOIN hospitals h ON h.id = d.id_hospital
    WHERE d.deleted_at IS NULL {hospital}"""


def _tickets(doctor: str = "") -> str:
    return f"""
    SELECT t.* FROM tickets t JOIN doctor_specialty ds ON ds.id = t.id_doctor_speciality
    WHERE t.time_begin > {NOON} {doctor}"""


def _bulk(rows: str, source: str, params: dict[str, str], keys: dict[str, str], columns: str) -> str:
    """`rows` r for each different row of parameters p, with the condition as it is called."""
    values = ", ".join(f"{v} AS {p}" for p, v in params.items())
    where = " AND ".join(f"(p.{p} IS NULL OR p.{p} = r.{k})" for p, k in keys.items())
    named = ", ".join(f"p.{p}" for p in keys)
    return with_tables(
        f"SELECT {named}, {columns} FROM params p JOIN ({rows}) r ON {where}",
        params=f"SELECT DISTINCT {values} FROM {source}",
    )


def _bulk_hospitals() -> str:
    named = "p_speciality, p_status"
    counted = _hospitals_literal(
        "AND (p_speciality IS NULL OR p_speciality = s.id) AND (p_status IS NULL OR p_status = h.status)",
        "",
    )
    counted = counted.replace("SELECT h.id", f"SELECT {named}, h.id", 1)
    counted = counted.replace("FROM hospitals h", "FROM params CROSS JOIN hospitals h", 1)
    counted = counted.replace("GROUP BY h.id", f"GROUP BY {named}, h.id", 1)
    values = "nullif(id_speciality, 3) AS p_speciality, nullif(id % 3, 2) AS p_status"
    return with_tables(counted, params=f"SELECT DISTINCT {values} FROM doctor_specialty")


def _bulk_statements() -> dict[str, str]:
    return {
        "bulk_towns": _bulk(
            "SELECT * FROM towns", "towns", {"p_region": "nullif(id_region, 2)"}, {"p_region": "id_region"}, "r.*"
        ),
        "bulk_specialities": _bulk(
            _specialities("intended"), "specialities", {"p_age_group": "nullif(id_age_group, 2)"},
            {"p_age_group": "id_age_group"}, "r.*",
        ),
        "bulk_hospitals": _bulk_hospitals(),
        "bulk_doctors": _bulk(
            "SELECT * FROM doctors WHERE deleted_at IS NULL", "hospitals", {"p_hospital": "nullif(id, 1)"},
            {"p_hospital": "id_hospital"}, "r.*",
        ),
        "bulk_tickets": _bulk(
            f"""SELECT t.*, ds.id_doctor FROM tickets t JOIN doctor_specialty ds
                ON ds.id = t.id_doctor_speciality WHERE t.time_begin > {NOON}""",
            "doctors", {"p_doctor": "nullif(id, 1)"}, {"p_doctor": "id_doctor"}, "r.* EXCLUDE (id_doctor)",
        ),
        "bulk_work_times": _bulk(
            "SELECT * FROM hospital_work_times", "hospital_work_times",
            {"p_hospital": "nullif(id_hospital, 1)", "p_week_day": "nullif(id_week_day, 7)"},
            {"p_hospital": "id_hospital", "p_week_day": "id_week_day"}, "r.*",
        ),
        "bulk_journals": _bulk(
            "SELECT * FROM patient_journals", "requests", {"p_patient": "nullif(id_patient, 5)"},
            {"p_patient": "id_patient"}, "r.*",
        ),
    }


def statements() -> dict[str, str]:
    plain = {
        "towns_all": "SELECT * FROM towns",
        "towns_by_region": "SELECT * FROM towns WHERE id_region = 1",
        "specialities_with_doctors_literal": _specialities("literal"),
        "specialities_with_doctors_intended": _specialities("intended"),
        "specialities_with_doctors_literal_age_group": _specialities(
            "literal", "AND s.id_age_group = 1"
        ),
        "specialities_with_doctors_intended_age_group": _specialities(
            "intended", "AND s.id_age_group = 1"
        ),
        "hospitals_by_speciality_literal": _hospitals_literal("", ""),
        "hospitals_by_speciality_literal_pos": _hospitals_literal("", _POS_LITERAL),
        "hospitals_by_speciality_literal_filtered": _hospitals_literal(
            "AND s.id = 5 AND h.status = 1", ""
        ),
        "hospitals_by_speciality_intended": _hospitals_intended("", "", ""),
        "hospitals_by_speciality_intended_pos": _hospitals_intended("", "", _POS_INTENDED),
        "hospitals_by_speciality_intended_filtered": _hospitals_intended(
            "AND h.status = 1", "AND s.id = 5", ""
        ),
        "doctors_by_hospital_literal": _doctors("ASC"),
        "doctors_by_hospital_intended": _doctors("DESC"),
        "doctors_by_hospital_one": """
            SELECT * FROM doctors WHERE deleted_at IS NULL AND id_hospital = 1""",
        "tickets_by_doctor": _tickets("AND ds.id_doctor = 1"),
        "tickets_all_doctors": _tickets(),
        "documents_by_patient_literal": "SELECT * FROM patient_documents WHERE id = 4",
        "documents_by_patient_literal_type": """
            SELECT * FROM patient_documents WHERE id = 4 AND id_document_type = 4""",
        "documents_by_patient_intended": """
            SELECT * FROM patient_documents WHERE id_patient = 4 AND id_document_type = 2""",
        "documents_by_patients_literal": """
            SELECT pd.* FROM patient_documents pd JOIN patients p ON p.id = pd.id""",
        "documents_by_patients_intended": """
            SELECT pd.* FROM patient_documents pd JOIN patients p ON p.id = pd.id_patient""",
        "hospital_work_time": "SELECT * FROM hospital_work_times WHERE id_hospital = 1",
        "hospital_work_time_day": """
            SELECT * FROM hospital_work_times WHERE id_hospital = 1 AND id_week_day = 3""",
        "hospital_work_time_every_day": "SELECT * FROM hospital_work_times WHERE id_week_day = 3",
        "hospitals_by_speciality_intended_sunday": _hospitals_intended("", "", "", day=2),
        "hospital_work_time_all": "SELECT * FROM hospital_work_times",
        "patient_journal": "SELECT * FROM patient_journals WHERE id_patient = 4",
        "patient_journal_all": "SELECT * FROM patient_journals",
    }
    plain["scalar_functions"] = """
        SELECT id, strftime(time_begin, '%H:%M') AS clock_text,
               CAST(isodow(time_begin) AS INTEGER) AS day_from_monday,
               CAST(dayofweek(time_begin) + 1 AS INTEGER) AS day_from_sunday,
               strftime(time_begin, '%Y.%m.%d') AS day_text,
               CAST(date_trunc('month', time_begin) AS DATE) AS month_begin,
               time_begin + INTERVAL 2 HOUR AS two_hours_later,
               CAST(CASE WHEN day = last_day(day) THEN last_day(day + INTERVAL 18 MONTH)
                         ELSE day + INTERVAL 18 MONTH END AS DATE) AS months_later,
               'ticket ' || id || CASE WHEN closed = 1 THEN ' closed' ELSE '' END AS label
        FROM (SELECT *, CAST(time_begin AS DATE) AS day FROM tickets)"""
    sorts = ", h.id_type = 1 AS sort_1, -count(d.id) AS sort_2, t.end_time AS sort_3"
    wanted = f""", h.id_type = 1 AS sort_1, count(DISTINCT d.id) AS sort_2,
             coalesce(any_value(t.end_time) > '{EVENING}', FALSE) AS sort_3"""
    plain |= {
        "sql_towns_by_region": plain["towns_by_region"],
        "sql_specialities_with_doctors": plain["specialities_with_doctors_literal_age_group"],
        "sql_hospitals_by_speciality": _hospitals_literal("", sorts),
        "sql_hospitals_by_speciality_filtered": _hospitals_literal(
            "AND s.id = 5 AND h.status = 1", sorts
        ),
        "sql_doctors_by_hospital": """
            SELECT *, -degree AS sort_1, area = 'area 2' AS sort_2
            FROM doctors WHERE deleted_at IS NULL""",
        "sql_tickets_by_doctor": plain["tickets_by_doctor"],
        "sql_documents_by_patient": plain["documents_by_patient_literal"],
        "sql_hospital_work_time": plain["hospital_work_time"],
        "sql_patient_journal": plain["patient_journal_all"],
        "sql_documents_by_patient_type": plain["documents_by_patient_literal_type"],
        "sql_hospital_work_time_day": plain["hospital_work_time_every_day"],
        "sql_intended_specialities": plain["specialities_with_doctors_intended_age_group"],
        "sql_intended_hospitals": _hospitals_intended("", "", wanted),
        "sql_intended_hospitals_filtered": _hospitals_intended(
            "AND h.status = 1", "AND s.id = 5", wanted
        ),
        "sql_intended_hospitals_sunday": _hospitals_intended("", "", wanted, day=2),
        "sql_intended_doctors": """
            SELECT *, degree AS sort_1, area = 'area 2' AS sort_2
            FROM doctors WHERE deleted_at IS NULL""",
        "sql_intended_documents": plain["documents_by_patient_intended"],
        "sql_each_region": """
            SELECT p_region, t.* FROM (SELECT DISTINCT nullif(id_region, 2) AS p_region FROM towns)
            JOIN towns t ON p_region IS NULL OR t.id_region = p_region""",
        "sql_each_doctor": f"""
            SELECT p_doctor, t.* EXCLUDE (id_doctor) FROM (SELECT DISTINCT nullif(id, 1) AS p_doctor FROM doctors)
            JOIN (SELECT t.*, l.id_doctor FROM tickets t JOIN doctor_specialty l
                  ON l.id = t.id_doctor_speciality WHERE t.time_begin > {NOON}) t
              ON t.id_doctor = p_doctor
            UNION ALL
            SELECT NULL, t.* FROM tickets t WHERE t.time_begin > {NOON}""",
        "sql_each_patient": """
            SELECT p_patient, j.* FROM
              (SELECT DISTINCT nullif(id_patient, 5) AS p_patient FROM patient_journals)
            JOIN patient_journals j ON j.id_patient = p_patient
            UNION ALL
            SELECT NULL, j.* FROM patient_journals j
            WHERE EXISTS (SELECT 1 FROM patient_journals WHERE nullif(id_patient, 5) IS NULL)""",
    }
    return {name: with_tables(sql) for name, sql in plain.items()} | _bulk_statements()
