"""Storage, positions, salted joins and the shape of plans."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from slotwise import Clinic
from slotwise.operators import reads
from slotwise.operators.generate import Fanout, generate_clinic
from slotwise.plans import ranking
from slotwise.plans.lineage import durable, shared_folder
from slotwise.plans.skew import hot_keys, spread_join
from slotwise.sql_api import register

AS_OF = dt.datetime(2024, 5, 13, 14, 30)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("clinic") / "tables")
    made = generate_clinic(
        spark.range(1, 3), spark.range(1, 6), AS_OF, Fanout(days=4, slots=3)
    )
    made.write(root)
    return made, Clinic.read(spark, root)


def test_round_trip(stored):
    made, clinic = stored
    for name in clinic.names():
        before, after = getattr(made, name), getattr(clinic, name)
        columns = before.columns
        assert after.select(columns).exceptAll(before).isEmpty(), name
        assert before.exceptAll(after.select(columns)).isEmpty(), name


def test_stored_tickets_skip_past_months(stored):
    _, clinic = stored
    later = dt.datetime(2024, 5, 16, 10, 10)
    df = reads.tickets_by_doctor(clinic, later)
    assert "PartitionFilters: [isnotnull(slot_month" in plan_of(df)
    assert df.columns == ["id", "id_doctor_speciality", "closed", "time_begin", "time_end"]
    assert df.count() == 600 * (2 + 3)
    assert df.agg(F.min("time_begin")).first()[0] == dt.datetime(2024, 5, 16, 10, 30)


def test_parameters_reach_the_scan(stored):
    _, clinic = stored
    plan = plan_of(reads.hospital_work_time(clinic, 5, 2))
    assert "EqualTo(id_hospital,5)" in plan and "EqualTo(id_week_day,2)" in plan
    assert "Filter" not in plan_of(reads.hospital_work_time(clinic)).split("FileScan")[0]


def test_only_needed_columns_are_read(stored):
    _, clinic = stored
    plan = plan_of(reads.hospitals_by_speciality(clinic, AS_OF))
    assert "salary" not in plan and "qualification" not in plan


def test_sql_functions(stored, spark):
    _, clinic = stored
    own = spark.newSession()
    root = clinic.towns.inputFiles()[0].rsplit("/towns/", 1)[0]
    register(own, Clinic.read(own, root))

    def ask(call, columns="id"):
        return sorted(map(tuple, own.sql(f"SELECT {columns} FROM {call}").collect()))

    assert len(ask("get_towns_by_region()")) == 4
    assert ask("get_towns_by_region(1)") == rows(reads.towns_by_region(clinic, 1), "id")
    assert ask("get_towns_by_region(p_id_region => 1)") == ask("get_towns_by_region(1)")
    late = "timestamp_ntz'2024-05-13 16:30:00'"
    evening = dt.datetime(2024, 5, 13, 16, 30)
    assert ask(f"get_hospitals_by_speciality(as_of => {late})", "id, doc_count") == sorted(
        rows(reads.hospitals_by_speciality(clinic, evening), "id", "doc_count")
    )
    ordered = own.sql(
        f"SELECT id FROM get_hospitals_by_speciality(as_of => {late}) "
        "ORDER BY sort_1, sort_2, sort_3 DESC, id"
    )
    assert rows(ordered, "id") == rows(reads.hospitals_by_speciality(clinic, evening), "id")
    area = own.sql(
        "SELECT id FROM get_doctors_by_hospital(p_area => 'area 2') ORDER BY sort_1, sort_2, id"
    )
    assert rows(area, "id") == rows(reads.doctors_by_hospital(clinic, None, "area 2"), "id")
    assert ask("get_documents_by_patient(p_id_patient => 9)") == [(9,)]
    assert ask("get_documents_by_patient(null)") == []
    assert ask("get_patient_journald_by_patient_id(7)", "id_ticket") == sorted(
        rows(reads.patient_journal(clinic, 7), "id_ticket")
    )
    plan = plan_of(own.sql("SELECT * FROM get_hospitals_work_time(p_id_hospital => 3)"))
    assert "EqualNullSafe(id_hospital,3)" in plan or "EqualTo(id_hospital,3)" in plan
    free = plan_of(own.sql("SELECT * FROM get_hospitals_work_time()"))
    assert "PushedFilters: []" in free


def test_sql_functions_for_each_row(stored, spark):
    """LATERAL calls become equi-joins and equal a loop of single calls, null included."""
    _, clinic = stored
    own = spark.newSession()
    root = clinic.towns.inputFiles()[0].rsplit("/towns/", 1)[0]
    register(own, Clinic.read(own, root))
    now = "timestamp_ntz'2024-05-13 14:30:00'"
    calls = {
        "get_towns_by_region({})": "id",
        f"get_tickets_by_doctor({{}}, {now})": "id",
        "get_patient_journald_by_patient_id({})": "id_ticket",
    }
    own.sql("SELECT nullif(id, 2) AS p FROM range(1, 6)").write.parquet(f"{root}-keys")
    own.read.parquet(f"{root}-keys").createOrReplaceTempView("keys")
    for call, key in calls.items():
        each = own.sql(f"SELECT p, {key} FROM keys, LATERAL {call.format('p')}")
        plan = plan_of(each)
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        single = [
            (p, r[0])
            for p in (1, None, 3, 4, 5)
            for r in own.sql(f"SELECT {key} FROM {call.format('null' if p is None else p)}").collect()
        ]
        assert single and sorted(map(str, map(tuple, each.collect()))) == sorted(map(str, single))
    one = plan_of(own.sql("SELECT * FROM get_patient_journald_by_patient_id(7)"))
    assert "Union" not in one and "EqualTo(id_patient,7)" in one


def test_positions_equal_one_window(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ID_RANGE", 16)
    df = spark.range(2000).select(
        (F.col("id") * 7 % 2003).alias("id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).alias("g"),
        (F.col("id") * 13 % 5).alias("x"),
        (F.col("id") * 17 % 3).alias("y"),
    )
    order = [F.desc("x"), F.asc("y")]
    for within in ([], ["g"]):
        placed = ranking.with_position(df, order, ["x", "y"], "id", within)
        window = Window.partitionBy(*within).orderBy(*order, "id")
        wanted = df.withColumn("pos", F.row_number().over(window))
        assert placed.columns == wanted.columns
        assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, wanted.collect()))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    facts = spark.range(3000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 400).alias("a"),
        (F.col("id") % 2).alias("b"),
    )
    lookup = spark.range(300).select(
        F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(1)).cast("array<long>")).alias("b")
    ).withColumn("name", F.concat_ws("-", "a", "b"))
    (hot,) = hot_keys(facts, ["a", "b"])
    assert len(hot) == 2  # key 7 with either b
    salted = spread_join(facts, lookup, ["a", "b"], hot, "seq", how)
    plain = facts.join(lookup, ["a", "b"], how)
    assert sorted(salted.columns) == sorted(plain.columns)
    columns = plain.columns
    assert sorted(map(str, salted.select(columns).collect())) == sorted(
        map(str, plain.collect())
    )


def test_hot_keys_of_nothing(spark):
    assert hot_keys(spark.range(0), ["id"]) == [[]]
    assert hot_keys(spark.range(100000), ["id"]) == [[]]


def test_aqe_splits_a_hot_link(spark):
    """Reads join facts straight from their shuffle, where a hot key is split at run time."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    own = spark.newSession()
    for name, value in settings.items():
        own.conf.set(name, value)
    n = 60000
    tickets = own.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 1000).alias("id_doctor_speciality"),
        F.lit(0).alias("closed"),
        F.lit("2024-06-01").cast("timestamp_ntz").alias("time_begin"),
        F.lit("2024-06-02").cast("timestamp_ntz").alias("time_end"),
    ).repartition(4)
    links = own.range(1000).select(
        "id", F.col("id").alias("id_speciality"), (F.col("id") * 0).alias("id_doctor")
    )
    clinic = Clinic({"tickets": tickets, "doctor_specialty": links})
    df = reads.tickets_by_doctor(clinic, AS_OF, 0)
    assert len(df.collect()) == n
    assert "skew=true" in plan_of(df)


def test_durable_uses_the_configured_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    kept = durable(spark.range(10))
    assert kept.count() == 10
    assert shared_folder(spark) == shared and shared in kept.inputFiles()[0]


def test_count_before_equals_one_window(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ID_RANGE", 16)
    df = spark.range(1500).select(
        (F.col("id") * 7 % 1511).alias("seq"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 9).alias("g"),
    )
    flag = F.col("seq") % 5 < 2
    window = Window.partitionBy("g").orderBy("seq").rowsBetween(*ranking.BEFORE)
    wanted = df.withColumn("n", F.coalesce(F.count_if(flag).over(window), F.lit(0)))
    counted = ranking.count_before(df, flag, ["g"], "seq", "n")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, wanted.collect()))


def test_whole_types_of_ids_join_alike(spark):
    """Hot keys find their lookup row whatever whole type the ids of the calls have."""
    lookup = spark.range(50).select(F.col("id").alias("k"))
    for kind in ("int", "bigint", "decimal(18,0)"):
        calls = spark.range(20_000).select(
            "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 60).cast(kind).alias("k")
        )
        (hot,) = hot_keys(calls, ["k"])
        assert hot
        assert spread_join(calls, lookup, ["k"], hot, "id").count() == calls.join(lookup, "k").count()


def test_positions_keep_null_keys(spark):
    rows = [(1, None), (2, 5), (3, None), (4, 2)]
    df = spark.createDataFrame(rows, "id long, degree int")
    found = ranking.with_position(df, [F.col("degree").asc_nulls_first()], ["degree"], "id")
    assert sorted((r.id, r.pos) for r in found.collect()) == [(1, 1), (2, 4), (3, 2), (4, 3)]
