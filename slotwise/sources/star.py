"""Domain tables derived from the star-schema test tables by plain arithmetic.

Keys are arithmetic on the source keys, so no table needs a global row number, and every
source row is used. Counts of source tables enter as scalar subqueries.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions.text import glue
from slotwise.plans.tasks import bounded_tasks
from slotwise.sources.clinic import Clinic
from slotwise.sources.lookups import LOOKUPS, lookup
from slotwise.sources.schemas import LOG, REQUESTS, TABLES


def _whole(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by))


def _each(first: int, last: int) -> Column:
    return F.explode(F.sequence(F.lit(first), F.lit(last)))


def _deleted(when: Column, number: Column) -> Column:
    """Deletion mark: the first of a month of 2019, else null."""
    day = F.make_date(F.lit(2019), (number % 11 + 1).cast("int"), F.lit(1))
    return F.when(when, day.cast("timestamp_ntz"))


def _slot_start(day: Column, number: Column) -> Column:
    minutes = (number % 20 * 30).cast("int")
    return day + F.make_dt_interval(F.lit(0), F.lit(10), minutes)


def star_clinic(spark: SparkSession, sf_dir: str) -> Clinic:
    """The clinic of a test data folder, with `requests`, `cancels` and `booking_log`."""

    @cache
    def src(name: str) -> DataFrame:
        return spark.read.schema(_SOURCES[name]).parquet(f"{sf_dir}/{name}.parquet")

    def count_of(name: str) -> Column:
        return src(name).agg(F.count(F.lit(1))).scalar()

    def regions():
        return src("region").select(
            F.col("r_regionkey").alias("id"),
            F.col("r_name").alias("name"),
            (F.col("r_regionkey") + 1).alias("code"),
        )

    def towns():
        return src("nation").select(
            F.col("n_nationkey").alias("id"),
            F.col("n_name").alias("name"),
            F.col("n_regionkey").alias("id_region"),
        )

    def organizations():
        return src("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            F.col("s_nationkey").alias("id_town"),
        )

    def hospitals():
        id = F.col("id")
        return (
            src("supplier")
            .select("s_suppkey", "s_name", _each(0, 2).alias("k"))
            .withColumn("id", F.col("s_suppkey") * 3 + F.col("k"))
            .select(
                "id",
                _deleted(id * 7 % 10 < 4, id).alias("deleted_at"),
                glue(F.col("s_name"), " hospital ", F.col("k") + 1).alias("name"),
                F.col("s_suppkey").alias("id_organization"),
                (id % 10).alias("status"),
                (id % 2 + 1).alias("id_type"),
            )
        )

    def hospital_work_times():
        h, w = F.col("id_hospital"), F.col("w")
        return (
            src("supplier")
            .select("s_suppkey", _each(0, 2).alias("k"))
            .select(
                (F.col("s_suppkey") * 3 + F.col("k")).alias("id_hospital"),
                _each(1, 7).alias("w"),
            )
            .select(
                (h * 7 + w).alias("id"),
                w.alias("id_week_day"),
                "id_hospital",
                glue("0", (h + w) % 3 + 6, ":00").alias("begin_time"),
                glue(h * w % 3 + 16, ":00").alias("end_time"),
            )
        )

    def doctors():
        id = F.col("p_partkey")
        return src("part").select(
            id.alias("id"),
            _deleted(id % 3 == 0, id).alias("deleted_at"),
            glue("area ", id % 5 + 1).alias("area"),
            F.col("p_size").alias("degree"),
            F.col("p_type").alias("qualification"),
            F.col("p_retailprice").alias("salary"),
            (id % (count_of("supplier") * 3)).alias("id_hospital"),
        )

    def doctors_reviews():
        conv, turn = F.col("conv_id"), F.col("turn")
        return src("conversations").select(
            (conv * 100 + turn).alias("id"),
            ((conv * 8 + turn) % count_of("part")).alias("id_doctor"),
            F.col("text").alias("review"),
            ((conv + turn) % 10).alias("rate"),
        )

    def specialities():
        id = F.col("p_partkey")
        quarter = _whole(id, 4)
        return src("part").select(
            id.alias("id"),
            _deleted(quarter % 3 == 0, id).alias("deleted_at"),
            (quarter % 5 + 1).alias("id_age_group"),
        )

    def doctor_specialty():
        p, j = F.col("p_partkey"), F.col("j")
        return (
            src("part")
            .select("p_partkey", _each(0, 2).alias("j"))
            .select(
                (p * 3 + j).alias("id"),
                ((p * 5 + j * 7) % count_of("part")).alias("id_speciality"),
                p.alias("id_doctor"),
            )
        )

    def speciality_gender():
        p = F.col("p_partkey")
        return (
            src("part")
            .select("p_partkey", _each(0, 1).alias("i"))
            .select(
                p.alias("id_speciality"),
                (F.col("i") * 2 + 2 - _whole(p, 4) % 2).alias("id_gender"),
            )
        )

    def users():
        key = F.col("c_custkey")
        return (
            src("customer")
            .groupBy((key - key % 5).alias("id"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(
                "id",
                glue("user ", F.col("id")).alias("name"),
                glue("user", F.col("id"), "@clinic.example").alias("email"),
                F.lit("dummy").alias("password"),
            )
        )

    def patients():
        id = F.col("c_custkey")
        return src("customer").select(
            id.alias("id"),
            (id - id % 5).alias("id_user"),
            F.col("c_name").alias("first_name"),
            F.col("c_mktsegment").alias("last_name"),
            F.lit(None).alias("patronymic"),
            F.make_date(
                (id * 37 % 81 + 1918).cast("int"), F.lit(6), F.lit(1)
            ).alias("birthdate"),
            (id % 4 + 1).alias("id_gender"),
            (id + 70000000000).alias("phone"),
            glue("area ", id % 47 + 1).alias("area"),
        )

    def patient_documents():
        c, j = F.col("c_custkey"), F.col("j")
        first = F.when(c % 3 == 0, 1).otherwise(4)
        second = F.when(c % 5 == 0, 4).otherwise(2)
        return (
            src("customer")
            .select("c_custkey", _each(0, 1).alias("j"))
            .select(
                (c * 2 + j).alias("id"),
                glue("document ", c * 2 + j).alias("name"),
                c.alias("id_patient"),
                glue("file", c * 2 + j).alias("file_name"),
                F.lit(None).alias("content"),
                F.when(j == 0, first).otherwise(second).alias("id_document_type"),
            )
        )

    @cache
    def sized():
        bounded_tasks(spark, src("lineitem"))

    def slots():
        """One row per order line number; repeated lines merge by column-wise minimum.

        The grouping key is the ticket id itself: repeated lines merge before the shuffle
        and the result is already spread by ticket id. Flags are numbers, since a minimum
        of text could not use the hash aggregate.
        """
        sized()
        return (
            src("lineitem")
            .select(
                (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
                "l_partkey",
                "l_shipdate",
                (F.col("l_linestatus") == "F").cast("int").alias("closed"),
                (F.col("l_returnflag") == "R").cast("int").alias("returned"),
            )
            .groupBy("id")
            .agg(
                F.min("l_partkey").alias("l_partkey"),
                F.min("l_shipdate").alias("l_shipdate"),
                F.max("closed").alias("closed"),
                F.min("returned").alias("returned"),
            )
        )

    def tickets():
        id, line = F.col("id"), F.col("id") % 8
        start = _slot_start(F.col("l_shipdate"), _whole(id, 8) + line)
        half_hour = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(30))
        return slots().select(
            "id",
            (F.col("l_partkey") * 3 + line % 3).alias("id_doctor_speciality"),
            "closed",
            start.alias("time_begin"),
            (start + half_hour).alias("time_end"),
        )

    def patient_journals():
        held = slots().filter("closed = 1 OR returned = 1")
        return held.join(
            src("orders"), _whole(held["id"], 8) == F.col("o_orderkey")
        ).select(
            F.col("o_custkey").alias("id_patient"),
            held["id"].alias("id_ticket"),
            (1 - F.col("closed")).alias("status"),
        )

    def typed(name, build):
        fields = TABLES[name].schema if name in TABLES else _INPUTS[name]
        casts = [f"CAST({f.name} AS {f.dataType.simpleString()}) {f.name}" for f in fields]
        return lambda: build().selectExpr(*casts)

    def requests():
        """Three patients ask for every ticket; holders of a cancelled booking ask again."""
        id, k = F.col("id"), F.col("k")
        asked = (
            clinic.tickets.select("id", _each(0, 2).alias("k"))
            .select(
                (id * 8 + k).alias("seq"),
                ((id * 7 + k * 4) % count_of("customer")).alias("id_patient"),
                id.alias("id_ticket"),
            )
        )
        again = clinic.patient_journals.filter("status = 1").select(
            (F.col("id_ticket") * 8 + 4).alias("seq"), "id_patient", "id_ticket"
        )
        return asked.unionByName(again)

    def cancels():
        """Every journal row is cancelled twice."""
        return clinic.patient_journals.select(
            "id_patient", "id_ticket", _each(0, 1).alias("k")
        ).select(
            (F.col("id_ticket") * 2 + F.col("k")).alias("seq"), "id_patient", "id_ticket"
        )

    def booking_log():
        """Requests and cancels in one order, sixteen places per ticket."""

        def calls(*rows):
            return F.explode(
                F.array(*[F.struct(*[F.lit(v) for v in row]) for row in rows])
            ).alias("call")

        place, op, k = (F.col(f"call.col{i}") for i in (1, 2, 3))
        asked = clinic.tickets.select(
            "id",
            calls(
                (0, "request", 0),
                (2, "request", 1),
                (3, "cancel", 0),
                (4, "request", 2),
                (13, "request", 1),
            ),
        ).select(
            (F.col("id") * 16 + place).alias("seq"),
            op.alias("op"),
            ((F.col("id") * 7 + k * 4) % count_of("customer")).alias("id_patient"),
            F.col("id").alias("id_ticket"),
        )
        held = clinic.patient_journals.select(
            "id_patient",
            "id_ticket",
            calls((5, "cancel"), (8, "request"), (11, "cancel")),
        ).select(
            (F.col("id_ticket") * 16 + place).alias("seq"),
            op.alias("op"),
            "id_patient",
            "id_ticket",
        )
        return asked.unionByName(held)

    tables = [
        regions, towns, organizations, hospitals, hospital_work_times, doctors,
        doctors_reviews, specialities, doctor_specialty, speciality_gender, users,
        patients, patient_documents, tickets, patient_journals,
        requests, cancels, booking_log,
    ]
    builders = {build.__name__: typed(build.__name__, build) for build in tables}
    builders |= {n: (lambda n=n: lookup(spark, n)) for n in LOOKUPS}
    builders["order_lines"] = lambda: src("lineitem")
    clinic = Clinic(builders)
    return clinic


# Declared, so that opening a file needs no job to look at its footer.
_SOURCES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "conversations": "conv_id BIGINT, turn BIGINT, text STRING",
}
_INPUTS = {"requests": REQUESTS, "cancels": REQUESTS, "booking_log": LOG}
