"""The eight parameterised reads.

A parameter of None stands for "all". Links are declared keys (`dq_foreign_key` checks
them), so a join that could only confirm a link is left out of the plan.

Where the rule as written and the rule as described differ, `semantics` picks "literal"
(as written, the default) or "intended" (as described).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions.clock import clock_text, week_day
from slotwise.functions.text import blank_to_none
from slotwise.plans.order import numbered
from slotwise.plans.ranking import with_position
from slotwise.sources.clinic import Clinic, tickets_after

PRIVATE = 1


def _intended(semantics: str) -> bool:
    if semantics not in ("literal", "intended"):
        raise ValueError(f"semantics is 'literal' or 'intended', not {semantics!r}")
    return semantics == "intended"


def _only(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters for the parameters that are given."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def live(df: DataFrame) -> DataFrame:
    """Rows without a deletion mark."""
    return df.filter(F.col("deleted_at").isNull())


def towns_by_region(clinic: Clinic, id_region: int | None = None) -> DataFrame:
    """Towns of one region."""
    return _only(clinic.towns, id_region=id_region)


def _live_doctor_links(clinic: Clinic) -> DataFrame:
    """Speciality links of live doctors in live hospitals: one `id_speciality` per link."""
    hospitals = live(clinic.hospitals).select(F.col("id").alias("id_hospital"))
    doctors = live(clinic.doctors).join(hospitals, "id_hospital", "left_semi")
    doctors = doctors.select(F.col("id").alias("id_doctor"))
    return clinic.doctor_specialty.join(doctors, "id_doctor", "left_semi").select(
        "id_speciality"
    )


def specialities_with_doctors(
    clinic: Clinic, age_group: int | None = None, *, semantics: str = "literal"
) -> DataFrame:
    """Specialities of live doctors in live hospitals.

    Literal: deleted specialities, one row per doctor link. Intended: live specialities
    with at least one such doctor, once each.
    """
    links = _live_doctor_links(clinic)
    specialities = _only(clinic.specialities, id_age_group=age_group)
    if _intended(semantics):
        matches = specialities["id"] == links["id_speciality"]
        return live(specialities).join(links, matches, "left_semi")
    deleted = specialities.filter(F.col("deleted_at").isNotNull())
    return links.join(deleted, links["id_speciality"] == deleted["id"]).select(
        *specialities.columns
    )


def hospitals_by_speciality(
    clinic: Clinic,
    as_of: dt.datetime,
    id_speciality: int | None = None,
    hospital_status: int | None = None,
    *,
    semantics: str = "literal",
    position: bool = False,
    week_start: int = 1,
) -> DataFrame:
    """Live hospitals of a speciality with their number of doctors.

    Literal: one row per hospital and closing time after now; the count multiplies doctor
    links by weekdays with that closing time; private hospitals come last. Intended: one
    row per hospital, distinct live doctors, private first, those still open higher.

    The result is sorted; with `position=True` it carries the place as `pos` instead.
    """
    if _intended(semantics):
        return _hospitals_intended(
            clinic, as_of, id_speciality, hospital_status, position, week_start
        )
    # count(doctors x links x weekdays) per hospital and closing time is the product of
    # two counts, so each side is counted before the join and nothing fans out.
    links = (
        _only(clinic.doctor_specialty, id_speciality=id_speciality)
        .groupBy("id_doctor")
        .agg(F.count(F.lit(1)).alias("links"))
    )
    staff = (
        clinic.doctors.select(F.col("id").alias("id_doctor"), "id_hospital")
        .join(links, "id_doctor")
        .groupBy("id_hospital")
        .agg(F.sum("links").alias("links"))
    )
    # A hospital has at most seven rows; spread by hospital they group and join in one shuffle.
    hours = (
        clinic.hospital_work_times.filter(F.col("end_time") > clock_text(as_of))
        .select("id_hospital", "end_time")
        .repartition("id_hospital")
        .groupBy("id_hospital", "end_time")
        .agg(F.count(F.lit(1)).alias("days"))
    )
    found = (
        _only(live(clinic.hospitals), status=hospital_status)
        .withColumnRenamed("id", "id_hospital")
        .join(staff, "id_hospital")
        .join(hours, "id_hospital")
        .select(
            F.col("id_hospital").alias("id"),
            "id_type",
            "name",
            "id_organization",
            "status",
            (F.col("links") * F.col("days")).alias("doc_count"),
            "end_time",
            (F.col("id_type") == PRIVATE).alias("_private"),
        )
    )
    order = [
        F.asc_nulls_last("_private"),
        F.desc_nulls_first("doc_count"),
        F.desc_nulls_first("end_time"),
    ]
    columns = ["id", "id_type", "name", "id_organization", "status", "doc_count"]
    if position:
        return numbered(found, [*order, F.asc("id")], "pos", 1).select(*columns, "pos")
    return found.orderBy(*order, "id").select(*columns)


def _hospitals_intended(
    clinic, as_of, id_speciality, hospital_status, position, week_start
) -> DataFrame:
    specialities = live(_only(clinic.specialities, id=id_speciality)).select(
        F.col("id").alias("id_speciality")
    )
    links = (
        _only(clinic.doctor_specialty, id_speciality=id_speciality)
        .join(specialities, "id_speciality", "left_semi")
        .select("id_doctor")
    )
    doctors = live(clinic.doctors)
    staff = (
        doctors.join(links, doctors["id"] == links["id_doctor"], "left_semi")
        .groupBy("id_hospital")
        .agg(F.count(F.lit(1)).alias("doc_count"))
    )
    today = clinic.hospital_work_times.filter(
        F.col("id_week_day") == week_day(as_of, week_start)
    ).select("id_hospital", "end_time")
    open_now = F.coalesce(F.col("end_time") > clock_text(as_of), F.lit(False))
    found = (
        _only(live(clinic.hospitals), status=hospital_status)
        .withColumnRenamed("id", "id_hospital")
        .join(staff, "id_hospital")
        .join(today, "id_hospital", "left")
        .select(
            F.col("id_hospital").alias("id"),
            "id_type",
            "name",
            "id_organization",
            "status",
            (F.col("status") != 0).alias("available"),
            "doc_count",
            "end_time",
            open_now.alias("open_now"),
            (F.col("id_type") == PRIVATE).alias("_private"),
        )
    )
    order = [F.desc("_private"), F.desc("doc_count"), F.desc("open_now")]
    if position:
        return numbered(found, [*order, F.asc("id")], "pos", 1).drop("_private")
    return found.orderBy(*order, "id").drop("_private")


def doctors_by_hospital(
    clinic: Clinic,
    id_hospital: int | None = None,
    area: str | None = None,
    *,
    semantics: str = "literal",
    position: bool = False,
) -> DataFrame:
    """Live doctors, highest degree first, then by whether their area is the patient's.

    Literal: a matching area comes last, and no area matches everyone. Intended: a
    matching area comes first. A doctor without an area does not match a given one. With `position=True` the place per hospital is added as
    `pos`, which ranks every hospital in one run.
    """
    area = blank_to_none(area)
    matches = F.lit(True) if area is None else F.equal_null(F.col("area"), F.lit(area))
    match_order = F.desc if _intended(semantics) else F.asc
    found = live(_only(clinic.doctors, id_hospital=id_hospital))
    columns = found.columns
    found = found.withColumn("_match", matches)
    order = [F.desc_nulls_first("degree"), match_order("_match")]
    if position:
        ranked = with_position(found, order, ["degree", "_match"], "id", ["id_hospital"])
        return ranked.select(*columns, "pos")
    return found.orderBy(*order, "id").select(*columns)


def tickets_by_doctor(
    clinic: Clinic, as_of: dt.datetime, id_doctor: int | None = None
) -> DataFrame:
    """Tickets of a doctor, open or closed, that begin after now."""
    ahead = tickets_after(clinic.tickets, as_of)
    if id_doctor is None:
        return ahead
    links = _only(clinic.doctor_specialty, id_doctor=id_doctor)
    return ahead.join(links, ahead["id_doctor_speciality"] == links["id"], "left_semi")


def documents_by_patient(
    clinic: Clinic,
    id_patient: int | None,
    id_document_type: int | None = None,
    *,
    semantics: str = "literal",
) -> DataFrame:
    """Literal: the document whose own id is `id_patient`. Intended: that patient's.

    The patient is required: None matches nothing.
    """
    column = "id_patient" if _intended(semantics) else "id"
    documents = _only(clinic.patient_documents, id_document_type=id_document_type)
    return documents.filter(F.col(column) == F.lit(id_patient).cast("long"))


def documents_by_patients(
    clinic: Clinic,
    patients: DataFrame,
    id_document_type: int | None = None,
    *,
    semantics: str = "literal",
) -> DataFrame:
    """`documents_by_patient` for every distinct `id` of `patients` in one join."""
    column = "id_patient" if _intended(semantics) else "id"
    documents = _only(clinic.patient_documents, id_document_type=id_document_type)
    return documents.join(patients, documents[column] == patients["id"], "left_semi")


def hospital_work_time(
    clinic: Clinic, id_hospital: int | None = None, id_week_day: int | None = None
) -> DataFrame:
    """Opening hours."""
    return _only(
        clinic.hospital_work_times, id_hospital=id_hospital, id_week_day=id_week_day
    )


def patient_journal(clinic: Clinic, id_patient: int | None = None) -> DataFrame:
    """Booking journal."""
    return _only(clinic.patient_journals, id_patient=id_patient)
