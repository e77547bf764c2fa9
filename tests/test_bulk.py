"""Reads for tables of parameters against one call per row of parameters."""

import datetime as dt

import pytest
from conftest import rows

from slotwise.operators import bulk, reads
from slotwise.plans import skew

EVENING = dt.datetime(2024, 5, 13, 9)


@pytest.fixture(scope="module")
def clinic(make_clinic):
    return make_clinic(
        hospitals=[dict(id=i, status=i % 2, id_type=1) for i in (1, 2, 3)],
        doctors=[dict(id=i, id_hospital=i % 3 + 1) for i in range(1, 8)],
        doctor_specialty=[dict(id=i, id_doctor=i % 7 + 1, id_speciality=i % 4 + 1) for i in range(1, 20)],
        specialities=[dict(id=i) for i in range(1, 5)],
        hospital_work_times=[
            dict(id=7 * h + d, id_week_day=d, id_hospital=h, end_time=f"{12 + h}:00") for h in (1, 2, 3) for d in (1, 2)
        ],
        tickets=[
            dict(id=i, id_doctor_speciality=i % 19 + 1, time_begin=dt.datetime(2024, 6, 1)) for i in range(1, 60)
        ],
        patient_journals=[dict(id_patient=i % 5 if i % 3 else 9, id_ticket=i) for i in range(1, 60)],
    )


def expected(params, call):
    """Rows of one call for each different row of parameters."""
    found = []
    for p in set(params):
        found += [(*p, *r) for r in rows(call(*p), "*")]
    return sorted(map(repr, found))


def check(spark, params, ddl, got, call):
    result = got(spark.createDataFrame(params, ddl))
    assert sorted(map(repr, (tuple(r) for r in result.collect()))) == expected(params, call)


def test_journals_with_a_hot_patient(clinic, spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 10)
    monkeypatch.setattr(skew, "SHARE", 0.2)
    params = [(9,), (9,), (1,), (77,), (None,)]
    check(spark, params, "p_patient int", lambda p: bulk.journals(clinic, p), lambda i: reads.patient_journal(clinic, i))


def test_two_parameters(clinic, spark):
    params = [(1, 1), (None, 2), (3, None), (None, None), (2, 9), (1, 1)]
    check(
        spark, params, "p_hospital long, p_week_day int",
        lambda p: bulk.work_times(clinic, p), lambda h, d: reads.hospital_work_time(clinic, h, d),
    )


def test_counts_by_parameter(clinic, spark):
    params = [(1, 1), (None, 0), (3, None), (None, None), (2, 0), (9, 1)]
    columns = ["id", "id_type", "name", "id_organization", "status", "doc_count"]
    check(
        spark, params, "p_speciality long, p_status int",
        lambda p: bulk.hospitals(clinic, EVENING, p),
        lambda s, t: reads.hospitals_by_speciality(clinic, EVENING, s, t).select(*columns),
    )


def test_tickets_and_no_parameters(clinic, spark):
    check(
        spark, [(1,), (4,)], "p_doctor long",
        lambda p: bulk.tickets(clinic, EVENING, p), lambda d: reads.tickets_by_doctor(clinic, EVENING, d),
    )
    none = spark.createDataFrame([], "p_doctor long")
    assert bulk.tickets(clinic, EVENING, none).collect() == []
