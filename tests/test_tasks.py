import datetime as dt

import pytest

from slotwise.operators import quality
from slotwise.plans import tasks
from slotwise.sources import star
from slotwise.sources.calls import call_faults
from slotwise.sources.schemas import LOG


@pytest.fixture
def own(spark):
    """A session of its own, so that its settings do not reach other tests."""
    return spark.newSession()


@pytest.fixture
def folder(spark, tmp_path):
    """Order lines, repeated and without an order too, and customers."""
    day = dt.datetime(1998, 6, 1)
    lines = [(i // 4, i % 3, i % 4, "R" if i % 2 else "N", "F" if i % 3 else "O", day) for i in range(2_000)]
    lines += lines[:10] + [(None, 1, 1, "R", "F", day)]
    tables = {
        "lineitem": lines,
        "orders": [(i, i % 7) for i in range(500)],
        "customer": [(i, f"c{i}", "x") for i in range(7)],
    }
    for name, found in tables.items():
        spark.createDataFrame(found, star._SOURCES[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def settings(spark):
    return {name: spark.conf.get(name, None) for name in (tasks.PARTITIONS, *tasks.SIZES)}


def test_shuffles_grow_with_the_order_lines(own, folder, monkeypatch):
    monkeypatch.setattr(tasks, "TASK_ROWS", 50)
    before = star.star_clinic(own, folder)
    assert before.names()  # nothing is set before a table of order lines is asked for
    assert settings(own)[tasks.PARTITIONS] is None
    log = before.booking_log
    assert settings(own) == {tasks.PARTITIONS: "41"} | {n: bounded for n, (_, bounded) in tasks.SIZES.items()}
    shuffled = log.groupBy("seq").count()
    shuffled.collect()
    plan = shuffled._jdf.queryExecution().toString()
    assert "hashpartitioning(seq" in plan and ", 41)" in plan


def test_results_are_those_of_the_usual_tasks(own, spark, folder, monkeypatch):
    def found(session):
        clinic = star.star_clinic(session, folder)
        faults = call_faults(clinic.booking_log, LOG).collect()
        pairs = quality.duplicates(clinic.patient_journals, ["id_patient", "id_ticket"]).count()
        return sorted(map(tuple, faults)), sorted(map(tuple, clinic.tickets.collect()), key=str), pairs

    usual = found(spark)
    monkeypatch.setattr(tasks, "TASK_ROWS", 50)
    assert found(own) == usual


def test_small_tables_and_the_callers_choice_change_nothing(own, folder, monkeypatch):
    before = settings(own)
    assert star.star_clinic(own, folder).tickets.columns and settings(own) == before
    monkeypatch.setattr(tasks, "TASK_ROWS", 50)
    own.conf.set(tasks.PARTITIONS, "300")
    for name in tasks.SIZES:
        own.conf.set(name, "32MB")
    assert star.star_clinic(own, folder).tickets.columns
    assert settings(own) == {tasks.PARTITIONS: "300"} | dict.fromkeys(tasks.SIZES, "32MB")
