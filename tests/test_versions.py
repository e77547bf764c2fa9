"""Stored versions that share folders, the journal in buckets, places from ranges."""

import datetime as dt
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from slotwise.operators import booking, reads
from slotwise.plans.order import numbered
from slotwise.plans.snapshots import journal_snapshot
from slotwise.sources.clinic import SLOT_MONTH
from slotwise.sources.versions import month_folders, read_version, store_bucketed

MONTHS = [dt.datetime(2024, m, 10, 9) for m in (5, 6, 7, 8)]
DECISIONS = "seq long, id_patient long, id_ticket long, accepted boolean"


@pytest.fixture
def stored(make_clinic, spark, tmp_path):
    tickets = [
        dict(id=10 * m + i, id_doctor_speciality=1, closed=i % 2, time_begin=begin)
        for m, begin in enumerate(MONTHS)
        for i in range(5)
    ]
    journal = [dict(id_patient=1, id_ticket=t["id"], status=t["id"] % 2) for t in tickets]
    clinic = make_clinic(tickets=tickets, patient_journals=journal)
    clinic.write(str(tmp_path / "first"))
    return type(clinic).read(spark, str(tmp_path / "first"))


def files(root):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(root)
        for f in names
    }


def closed(tickets):
    return dict(rows(tickets, "id", "closed"))


def test_only_changed_months_are_written(stored, spark, tmp_path):
    before, first = closed(stored.tickets), files(tmp_path / "first")
    decided = spark.createDataFrame([(1, 5, 0, True), (2, 5, 20, True), (3, 5, 30, False)], DECISIONS)
    second = booking.store_batch(
        stored, decided, str(tmp_path / "second"), kind="booking", semantics="intended"
    )
    assert files(tmp_path / "first") == first
    assert sorted(os.listdir(tmp_path / "second" / "tickets"))[-2:] == [
        f"{SLOT_MONTH}=2024-05-01", f"{SLOT_MONTH}=2024-07-01"
    ]
    wanted = before | {0: 1, 20: 1}
    assert closed(second.tickets) == closed(read_version(spark, str(tmp_path / "second"))) == wanted
    # The next version refers to folders of both; earlier ones stay as they are.
    cancels = spark.createDataFrame([(1, 5, 20, True)], DECISIONS)
    third = booking.store_batch(second, cancels, str(tmp_path / "third"), kind="cancel")
    assert closed(third.tickets) == wanted | {20: 0}
    assert closed(second.tickets) == wanted and closed(stored.tickets) == before
    roots = {m: f.split("/")[-3] for m, f in month_folders(third.tickets).items()}
    assert roots == {
        "2024-05-01": "second", "2024-06-01": "first", "2024-07-01": "third", "2024-08-01": "first"
    }
    plan = third.tickets.filter(F.col(SLOT_MONTH) >= F.lit(dt.date(2024, 8, 1)))
    assert len(plan.inputFiles()) >= 1 and plan.count() == 5


def test_nothing_changes_and_nothing_is_written(stored, spark, tmp_path):
    decided = spark.createDataFrame([(1, 1, 1, True), (2, 1, 999, True), (3, 1, 0, False)], DECISIONS)
    new = booking.store_batch(
        stored, decided, str(tmp_path / "same"), kind="booking", semantics="intended"
    )
    assert not os.path.exists(tmp_path / "same" / "tickets")
    assert closed(new.tickets) == closed(stored.tickets)


def exchanges_above(df, text):
    """Shuffles on the way from a scan of `text` to the top, as the plan is indented."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-|*()0123456789"))
    found = []
    for i, line in enumerate(lines):
        if "FileScan" in line and text in line:
            level, above = depth(line), 0
            for up in reversed(lines[:i]):
                if depth(up) < level:
                    level = depth(up)
                    above += "Exchange" in up and "Broadcast" not in up
            found.append(above)
    assert found
    return found


def test_journal_is_not_moved(stored, spark, tmp_path):
    journal = stored.patient_journals
    pairs = [(1, 0, 7), (1, 21, 7), (9, 9, 7)]
    changes = spark.createDataFrame(pairs, "id_patient long, id_ticket long, new_status int")
    wanted = {(p, t): s for p, t, s in rows(journal, "id_patient", "id_ticket", "status")}
    wanted |= {(p, t): s for p, t, s in pairs}

    def check(df):
        assert {(p, t): s for p, t, s in rows(df, "id_patient", "id_ticket", "status")} == wanted
        assert df.count() == len(wanted)

    small = journal_snapshot(journal, changes)
    check(small)
    assert set(exchanges_above(small, "first/patient_journals")) == {0}
    # A journal in buckets stays where it is also if the changes are too many to broadcast.
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    bucketed = store_bucketed(
        journal, "patient_journals", ["id_patient", "id_ticket"], 4, "journal_buckets",
        str(tmp_path / "buckets"),
    )
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        large = journal_snapshot(bucketed, changes)
        check(large)
        kept_rows = large._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in kept_rows
        assert 0 in exchanges_above(large, "buckets")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        spark.sql("DROP TABLE journal_buckets")


def test_places_from_ranges(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("x"), F.col("id").alias("id")).repartition(9)
    placed = numbered(df, [F.desc("x"), F.asc("id")], "pos", 1)
    wanted = sorted((-(i % 7), i) for i in range(1000))
    assert [i for _, i in sorted(rows(placed, "pos", "id"))] == [i for _, i in wanted]
    assert sorted(r[0] for r in rows(placed, "pos")) == list(range(1, 1001))
    assert numbered(df.limit(0), [F.asc("id")], "pos").collect() == []


def test_positions_have_no_single_partition(make_clinic):
    clinic = make_clinic(
        hospitals=[dict(id=1, id_type=1)], doctors=[dict(id=1)], doctor_specialty=[dict(id=1)],
        hospital_work_times=[dict(id=1, id_week_day=1, id_hospital=1, end_time="18:00")],
    )
    df = reads.hospitals_by_speciality(clinic, dt.datetime(2024, 5, 13, 9), position=True)
    assert rows(df, "id", "pos") == [(1, 1)]
    assert "SinglePartition" not in df._jdf.queryExecution().toString()
