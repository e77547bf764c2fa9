"""Small tables with the exact expected rows, for both readings of each rule."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from slotwise import Clinic
from slotwise.operators import reads

GONE = dt.datetime(2019, 3, 1)
EVENING = dt.datetime(2024, 5, 13, 16, 30)  # a Monday


def work_time(id, hospital, day, end, begin="08:00"):
    return dict(id=id, id_hospital=hospital, id_week_day=day, begin_time=begin, end_time=end)


@pytest.fixture(scope="module")
def clinic(make_clinic):
    return make_clinic(
        towns=[dict(id=1, name="a", id_region=1), dict(id=2, name="b", id_region=2)],
        hospitals=[
            dict(id=1, id_type=1, status=3, name="private"),
            dict(id=2, id_type=2, status=0, name="state"),
            dict(id=3, id_type=2, status=1, deleted_at=GONE),
            dict(id=4, id_type=2, status=5, name="early"),
        ],
        doctors=[
            dict(id=1, id_hospital=1, degree=5, area="north"),
            dict(id=2, id_hospital=1, degree=5, area="south"),
            dict(id=3, id_hospital=1, degree=9, area="south", deleted_at=GONE),
            dict(id=4, id_hospital=2, degree=1, area="north"),
            dict(id=5, id_hospital=3, degree=2, area="north"),
            dict(id=6, id_hospital=1, degree=7, area="west"),
            dict(id=7, id_hospital=4, degree=7, area="west"),
        ],
        specialities=[
            dict(id=10, id_age_group=1),
            dict(id=11, id_age_group=1, deleted_at=GONE),
            dict(id=12, id_age_group=2, deleted_at=GONE),
            dict(id=13, id_age_group=2),
        ],
        doctor_specialty=[
            dict(id=1, id_speciality=10, id_doctor=1),
            dict(id=2, id_speciality=11, id_doctor=1),
            dict(id=3, id_speciality=11, id_doctor=2),
            dict(id=4, id_speciality=12, id_doctor=3),
            dict(id=5, id_speciality=12, id_doctor=5),
            dict(id=6, id_speciality=10, id_doctor=4),
            dict(id=7, id_speciality=13, id_doctor=3),
            dict(id=8, id_speciality=10, id_doctor=7),
        ],
        hospital_work_times=[
            work_time(1, 1, 1, "18:00"),
            work_time(2, 1, 2, "18:00"),
            work_time(3, 1, 3, "17:00"),
            work_time(4, 1, 4, "16:00"),
            work_time(5, 2, 1, "16:00"),
            work_time(6, 2, 2, "18:00"),
            work_time(7, 3, 1, "18:00"),
            work_time(8, 4, 1, "16:30"),
            work_time(9, 4, 2, None),
        ],
        tickets=[
            dict(id=1, id_doctor_speciality=1, closed=0, time_begin=EVENING),
            dict(id=2, id_doctor_speciality=1, closed=1, time_begin=EVENING + dt.timedelta(0, 1)),
            dict(id=3, id_doctor_speciality=6, closed=0, time_begin=dt.datetime(2024, 6, 1)),
            dict(id=4, id_doctor_speciality=1, closed=0, time_begin=dt.datetime(2024, 1, 1)),
        ],
        patient_documents=[
            dict(id=4, id_patient=9, id_document_type=2),
            dict(id=5, id_patient=4, id_document_type=1),
            dict(id=6, id_patient=4, id_document_type=2),
        ],
        patient_journals=[
            dict(id_patient=4, id_ticket=1, status=0),
            dict(id_patient=5, id_ticket=1, status=1),
        ],
    )


def test_towns(clinic):
    assert rows(reads.towns_by_region(clinic, 2), "id") == [(2,)]
    assert reads.towns_by_region(clinic).count() == 2


def test_deleted_specialities_once_per_doctor(clinic):
    df = reads.specialities_with_doctors(clinic)
    assert sorted(rows(df, "id")) == [(11,), (11,)]
    assert df.columns == ["id", "deleted_at", "id_age_group"]
    assert reads.specialities_with_doctors(clinic, 2).count() == 0


def test_live_specialities_with_a_doctor(clinic):
    df = reads.specialities_with_doctors(clinic, semantics="intended")
    assert rows(df, "id") == [(10,)]
    assert reads.specialities_with_doctors(clinic, 2, semantics="intended").count() == 0


def test_hospitals_as_written(clinic):
    """Deleted doctors count, days with one closing time multiply, private comes last."""
    df = reads.hospitals_by_speciality(clinic, EVENING)
    assert df.columns == ["id", "id_type", "name", "id_organization", "status", "doc_count"]
    # Hospital 1: links 1 + 2 of doctor 1, 3 of doctor 2, 4 + 7 of doctor 3: five.
    assert rows(df, "id", "doc_count") == [(2, 1), (1, 10), (1, 5)]
    placed = reads.hospitals_by_speciality(clinic, EVENING, position=True)
    assert sorted(rows(placed, "pos", "id", "doc_count")) == [(1, 2, 1), (2, 1, 10), (3, 1, 5)]


def test_hospitals_as_written_with_parameters(clinic):
    assert rows(reads.hospitals_by_speciality(clinic, EVENING, 11), "id", "doc_count") == [
        (1, 4),
        (1, 2),
    ]
    assert rows(reads.hospitals_by_speciality(clinic, EVENING, None, 0), "id") == [(2,)]
    assert reads.hospitals_by_speciality(clinic, EVENING, 11, 0).count() == 0


def test_hospitals_as_described(clinic):
    """Distinct live doctors with a live speciality; private and still open first."""
    df = reads.hospitals_by_speciality(clinic, EVENING, semantics="intended")
    assert rows(df, "id", "available", "doc_count", "end_time", "open_now") == [
        (1, True, 1, "18:00", True),
        (2, False, 1, "16:00", False),
        (4, True, 1, "16:30", False),
    ]
    placed = reads.hospitals_by_speciality(
        clinic, EVENING, semantics="intended", position=True
    )
    assert sorted(rows(placed, "pos", "id")) == [(1, 1), (2, 2), (3, 4)]


def test_doctors_matching_area_last_or_first(clinic):
    literal = reads.doctors_by_hospital(clinic, 1, "north")
    assert rows(literal, "id") == [(6,), (2,), (1,)]
    intended = reads.doctors_by_hospital(clinic, 1, "north", semantics="intended")
    assert rows(intended, "id") == [(6,), (1,), (2,)]


@pytest.mark.parametrize("area", [None, ""])
def test_doctors_without_area(clinic, area):
    assert rows(reads.doctors_by_hospital(clinic, 1, area), "id") == [(6,), (1,), (2,)]


def test_doctors_of_a_deleted_hospital_stay(clinic):
    df = reads.doctors_by_hospital(clinic, None, "north", position=True)
    assert sorted(rows(df, "id_hospital", "pos", "id")) == [
        (1, 1, 6),
        (1, 2, 2),
        (1, 3, 1),
        (2, 1, 4),
        (3, 1, 5),
        (4, 1, 7),
    ]


def test_tickets_begin_strictly_later(clinic):
    assert sorted(rows(reads.tickets_by_doctor(clinic, EVENING), "id")) == [(2,), (3,)]
    assert rows(reads.tickets_by_doctor(clinic, EVENING, 1), "id") == [(2,)]


def test_documents_by_own_id_or_by_patient(clinic, spark):
    assert rows(reads.documents_by_patient(clinic, 4), "id") == [(4,)]
    assert rows(reads.documents_by_patient(clinic, 4, 1), "id") == []
    own = reads.documents_by_patient(clinic, 4, 2, semantics="intended")
    assert rows(own, "id") == [(6,)]
    assert reads.documents_by_patient(clinic, None).count() == 0
    several = spark.createDataFrame([(4,), (4,), (9,)], "id long")
    found = reads.documents_by_patients(clinic, several, semantics="intended")
    assert sorted(rows(found, "id")) == [(4,), (5,), (6,)]


def test_opening_hours_and_journal(clinic):
    assert reads.hospital_work_time(clinic, 1).count() == 4
    assert rows(reads.hospital_work_time(clinic, 1, 3), "end_time") == [("17:00",)]
    assert rows(reads.hospital_work_time(clinic, None, 3), "id") == [(3,)]
    assert rows(reads.patient_journal(clinic, 5), "status") == [(1,)]
    assert reads.patient_journal(clinic).count() == 2


def test_unknown_semantics(clinic):
    with pytest.raises(ValueError):
        reads.specialities_with_doctors(clinic, semantics="other")


def test_sort_uses_null_order_of_the_rules(clinic):
    """A descending key puts nulls first."""
    plan = reads.doctors_by_hospital(clinic, 1, "north")._jdf.queryExecution().toString()
    assert "DESC NULLS FIRST" in plan


def test_a_doctor_without_an_area_does_not_match(make_clinic):
    areas = {1: "area 1", 2: "none", 3: "area 2"}
    made = make_clinic(doctors=[{"id": k, "area": v, "degree": 1, "id_hospital": 1} for k, v in areas.items()])
    made = made.replace(doctors=made.doctors.withColumn("area", F.nullif("area", F.lit("none"))))
    assert rows(reads.doctors_by_hospital(made, None, "area 2"), "id") == [(1,), (2,), (3,)]
    assert rows(reads.doctors_by_hospital(made, None, "area 1", semantics="intended"), "id") == [(1,), (2,), (3,)]


def test_an_absent_required_column_is_found_on_load(spark, make_clinic, tmp_path):
    made = make_clinic(towns=[{"id": 1}], hospitals=[{"id": 1}])
    made.towns.drop("name").write.parquet(f"{tmp_path}/towns")
    made.hospitals.drop("deleted_at").write.parquet(f"{tmp_path}/hospitals")
    (tmp_path / "tickets").mkdir()
    stored = Clinic.read(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no column name of towns"):
        stored.towns.count()
    assert rows(stored.hospitals, "deleted_at") == [(None,)]
    assert stored.tickets.count() == 0
