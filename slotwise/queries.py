"""The registered queries: every operator over the tables of a test data folder."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import clock
from slotwise.functions.text import glue
from slotwise.operators import booking, bulk, generate, quality, reads
from slotwise.plans.lineage import shared_folder
from slotwise.sources.calls import call_faults, checked_calls
from slotwise.sources.clinic import Clinic, apply_defaults
from slotwise.sources.schemas import LOG, REQUESTS, TABLES
from slotwise.sources.star import star_clinic
from slotwise.sql_api import register

NOON = dt.datetime(1998, 6, 15, 14, 30)  # a Monday; bookings, cancels and tickets
EVENING = dt.datetime(1998, 6, 15, 16, 30)  # opening hours
SEMANTICS = ("literal", "intended")

Query = Callable[[Clinic], DataFrame]


def _reads() -> dict[str, Query]:
    found: dict[str, Query] = {
        "towns_all": lambda c: reads.towns_by_region(c),
        "towns_by_region": lambda c: reads.towns_by_region(c, 1),
        "hospitals_by_speciality_literal_filtered": lambda c: reads.hospitals_by_speciality(
            c, EVENING, 5, 1
        ),
        "hospitals_by_speciality_intended_filtered": lambda c: reads.hospitals_by_speciality(
            c, EVENING, 5, 1, semantics="intended"
        ),
        "doctors_by_hospital_one": lambda c: reads.doctors_by_hospital(c, 1, "area 2"),
        "tickets_by_doctor": lambda c: reads.tickets_by_doctor(c, NOON, 1),
        "tickets_all_doctors": lambda c: reads.tickets_by_doctor(c, NOON),
        "documents_by_patient_literal": lambda c: reads.documents_by_patient(c, 4),
        "documents_by_patient_literal_type": lambda c: reads.documents_by_patient(c, 4, 4),
        "documents_by_patient_intended": lambda c: reads.documents_by_patient(
            c, 4, 2, semantics="intended"
        ),
        "hospital_work_time": lambda c: reads.hospital_work_time(c, 1),
        "hospital_work_time_day": lambda c: reads.hospital_work_time(c, 1, 3),
        "hospital_work_time_every_day": lambda c: reads.hospital_work_time(c, None, 3),
        "hospitals_by_speciality_intended_sunday": lambda c: reads.hospitals_by_speciality(
            c, EVENING, semantics="intended", week_start=7
        ),
        "hospital_work_time_all": lambda c: reads.hospital_work_time(c),
        "patient_journal": lambda c: reads.patient_journal(c, 4),
        "patient_journal_all": lambda c: reads.patient_journal(c),
    }
    for s in SEMANTICS:
        found |= {
            f"specialities_with_doctors_{s}": lambda c, s=s: (
                reads.specialities_with_doctors(c, semantics=s)
            ),
            f"specialities_with_doctors_{s}_age_group": lambda c, s=s: (
                reads.specialities_with_doctors(c, 1, semantics=s)
            ),
            f"hospitals_by_speciality_{s}": lambda c, s=s: (
                reads.hospitals_by_speciality(c, EVENING, semantics=s)
            ),
            f"hospitals_by_speciality_{s}_pos": lambda c, s=s: (
                reads.hospitals_by_speciality(c, EVENING, semantics=s, position=True)
            ),
            f"doctors_by_hospital_{s}": lambda c, s=s: (
                reads.doctors_by_hospital(c, None, "area 2", semantics=s, position=True)
            ),
            f"documents_by_patients_{s}": lambda c, s=s: (
                reads.documents_by_patients(c, c.patients, semantics=s)
            ),
        }
    return found


# Columns of a log as a careless feed may send them.
SPOILT_CALLS = {
    "seq": "CASE WHEN id_ticket % 10 = 1 THEN NULL WHEN id_ticket % 10 = 3 THEN 7 ELSE seq END",
    "op": "CASE WHEN id_ticket % 9 = 0 THEN NULL WHEN id_ticket % 9 = 1 THEN 'move' ELSE op END",
    "id_patient": "CASE WHEN id_patient % 7 = 0 THEN 'x' || id_patient "
    "WHEN id_patient % 7 = 1 THEN id_patient || '.5' ELSE ' ' || id_patient END",
    "id_ticket": "CASE WHEN id_ticket % 8 = 0 THEN NULL ELSE id_ticket + 0.25 * (id_ticket % 2) END",
}


def _bookings() -> dict[str, Query]:
    def decided(c: Clinic, semantics: str) -> DataFrame:
        return booking.booking_decisions(c, c.requests, NOON, semantics=semantics)

    def cancelled(c: Clinic) -> DataFrame:
        return booking.cancel_decisions(c, c.cancels, NOON)

    def logged(c: Clinic, semantics: str = "intended") -> DataFrame:
        return booking.booking_log(c, c.booking_log, NOON, semantics=semantics)

    def from_text(c: Clinic) -> DataFrame:
        """The requests as a feed of text sends them."""
        feed = c.requests.select(
            "seq", glue(" ", F.col("id_patient"), " ").alias("id_patient"), glue(F.col("id_ticket"), ".0").alias("id_ticket")
        )
        return checked_calls(feed, REQUESTS)

    def in_ints(c: Clinic) -> DataFrame:
        ints = [F.col(n).cast("int").alias(n) for n in ("seq", "id_patient", "id_ticket")]
        return checked_calls(c.cancels.select(*ints), REQUESTS)

    found: dict[str, Query] = {
        "booking_decisions_from_text": lambda c: booking.booking_decisions(c, from_text(c), NOON),
        "cancel_decisions_from_int": lambda c: booking.cancel_decisions(c, in_ints(c), NOON),
        "call_faults": lambda c: call_faults(c.booking_log, LOG),
        "call_faults_spoiled": lambda c: call_faults(
            c.booking_log.withColumns({k: F.expr(v) for k, v in SPOILT_CALLS.items()}), LOG
        ),
        "booking_eligibility": lambda c: booking.booking_eligibility(c, c.requests, NOON),
        "cancel_decisions": cancelled,
        "journal_after_cancel": lambda c: booking.journal_after_cancel(c, cancelled(c)),
        "tickets_after_cancel": lambda c: booking.tickets_after_cancel(c, cancelled(c)),
        "booking_log": logged,
        "journal_after_log": lambda c: booking.journal_after_log(c, logged(c)),
        "tickets_after_log": lambda c: booking.tickets_after_log(c, logged(c)),
        "booking_log_literal": lambda c: logged(c, "literal"),
        "journal_after_log_literal": lambda c: booking.journal_after_log(
            c, logged(c, "literal"), semantics="literal"
        ),
        "tickets_after_log_literal": lambda c: booking.tickets_after_log(c, logged(c, "literal")),
    }
    for s in SEMANTICS:
        found |= {
            f"booking_decisions_{s}": lambda c, s=s: decided(c, s),
            f"journal_after_booking_{s}": lambda c, s=s: booking.journal_after_booking(
                c, decided(c, s), semantics=s
            ),
            f"tickets_after_booking_{s}": lambda c, s=s: booking.tickets_after_booking(
                c, decided(c, s)
            ),
        }
    return found


# Columns of the clinic with values that break each kind of constraint, and rows given twice.
SPOILT = {
    "towns": {"name": "CASE WHEN id % 5 = 1 THEN NULL ELSE name END"},
    "regions": {"code": "CASE WHEN id = 1 THEN code + 1000 ELSE code END"},
    "patients": {
        "id_gender": "CASE WHEN id % 7 = 0 THEN 99 ELSE id_gender END",
        "area": "CASE WHEN id % 11 = 0 THEN NULL ELSE area END",
        "first_name": "CASE WHEN id % 13 = 0 THEN repeat('x', 300) ELSE first_name END",
    },
    "hospital_work_times": {
        "id_week_day": "CASE WHEN id % 9 = 0 THEN 12 ELSE id_week_day END",
        "end_time": "CASE WHEN id % 10 = 0 THEN '18:00:00' ELSE end_time END",
    },
    "tickets": {
        "id_doctor_speciality": "CASE WHEN id % 100 = 0 THEN -1 ELSE id_doctor_speciality END",
        "closed": "CASE WHEN id % 50 = 0 THEN 10 ELSE closed END",
    },
    "patient_journals": {"id_patient": "CASE WHEN id_ticket % 1000 = 1 THEN -5 ELSE id_patient END"},
}
TWICE = {"towns": "id % 3 = 0", "patient_journals": "id_ticket % 10 = 0", "doctors": "id % 8 = 0"}


def _spoiled(c: Clinic) -> Clinic:
    """The clinic with rows that break keys, links, required columns and domains."""
    tables = {}
    for name in {**SPOILT, **TWICE}:
        df = getattr(c, name)
        if name in TWICE:
            df = df.unionByName(df.filter(TWICE[name]))
        tables[name] = df.withColumns({k: F.expr(v) for k, v in SPOILT.get(name, {}).items()})
    return c.replace(**tables)


def _kept_spoiled(c: Clinic) -> DataFrame:
    """The report on the plain clinic, moved by the rows that `_spoiled` changes and adds."""
    added, removed = {}, {}
    for name in {**SPOILT, **TWICE}:
        df = getattr(c, name)
        values = {k: F.expr(v) for k, v in SPOILT.get(name, {}).items()}
        changes = [~F.equal_null(F.col(k), v) for k, v in values.items()]
        changed = df.filter(reduce(or_, changes, F.lit(False)))
        new = changed.withColumns(values)
        if name in TWICE:
            new = new.unionByName(df.filter(TWICE[name]).withColumns(values))
        added[name], removed[name] = new, changed
    spark = c.towns.sparkSession
    kept = quality.KeptChecks.start(c, f"{shared_folder(spark)}/checks-{uuid.uuid4().hex}")
    return kept.update(added, removed).report()


def _checks() -> dict[str, Query]:
    def nulls_for_zero(c: Clinic) -> DataFrame:
        return c.tickets.withColumn("closed", F.nullif("closed", F.lit(0)))

    def spoiled(report: Query) -> Query:
        return lambda c: report(_spoiled(c))

    reports = {
        "dq_unique": quality.dq_unique,
        "dq_foreign_key": quality.dq_foreign_key,
        "dq_not_null": quality.dq_not_null,
        "dq_domain": quality.dq_domain,
        "dq_all": quality.dq_all,
    }
    return reports | {f"{name}_spoiled": spoiled(report) for name, report in reports.items()} | {
        "dq_kept_spoiled": _kept_spoiled,
        "duplicate_order_lines": lambda c: quality.duplicates(
            c.order_lines, ["l_orderkey", "l_linenumber"]
        ),
        "orphan_requests": lambda c: quality.orphans(c.requests, "id_patient", c.users),
        "apply_defaults_missing_column": lambda c: apply_defaults(
            c.hospitals.drop("status"), "hospitals"
        ),
        "apply_defaults_nulls": lambda c: apply_defaults(nulls_for_zero(c), "tickets"),
    }


def _scalars(c: Clinic) -> DataFrame:
    """The scalar functions on every ticket."""
    begin, day = F.col("time_begin"), F.to_date("time_begin")
    first = glue(F.year(begin), ".", F.month(begin), ".01")
    return c.tickets.select(
        "id",
        clock.clock_text_of(begin).alias("clock_text"),
        clock.week_day_of(begin).cast("int").alias("day_from_monday"),
        clock.week_day_of(begin, 7).cast("int").alias("day_from_sunday"),
        clock.day_text_of(begin).alias("day_text"),
        clock.parse_day(first).alias("month_begin"),
        clock.later(begin, hours=2).alias("two_hours_later"),
        clock.add_months(day, F.lit(18)).alias("months_later"),
        glue("ticket ", F.col("id"), F.when(F.col("closed") == 1, " closed")).alias("label"),
    )


def _calendar_days(c: Clinic) -> DataFrame:
    """The whole calendar of every doctor's speciality, summed up per day."""
    return (
        generate.slot_calendar(c.doctor_specialty, NOON, first_link=0)
        .groupBy("id_doctor_speciality", F.to_date("time_begin").alias("slot_date"))
        .agg(
            F.count(F.lit(1)).alias("n_slots"),
            F.sum("closed").alias("n_closed"),
            F.min("time_begin").alias("first_begin"),
            F.max("time_end").alias("last_end"),
            F.sum("id").alias("id_sum"),
        )
    )


def _generated(c: Clinic) -> DataFrame:
    """Rows, a sum of the drawn values and one over the text of all columns, per generated table."""
    from_one = (F.col("id") + 1).alias("id")
    regions, users = c.organizations.select(from_one), c.patients.select(from_one)
    made = generate.generate_clinic(regions, users, NOON)
    month = "coalesce(month(deleted_at), 0)"
    minutes = "hour(time_begin) * 60 + minute(time_begin)"
    values = {
        "regions": "code",
        "towns": "id",
        "organizations": "id",
        "hospitals": f"{month} + status * 10 + id_type",
        "hospital_work_times": "id_week_day * 10000 + int(left(begin_time, 2)) * 100 "
        "+ int(left(end_time, 2))",
        "doctors": f"{month} + int(right(area, 1)) * 100 + degree + bigint(salary)",
        "doctors_reviews": "rate",
        "specialities": f"{month} * 10 + id_age_group",
        "speciality_gender": "id_gender",
        "doctor_specialty": "id_doctor",
        "users": "ascii(email) + ascii(password)",
        "patients": "year(birthdate) + id_gender + phone % 100000 + ascii(first_name) "
        "+ int(substr(area, 6))",
        "patient_documents": "id_document_type + ascii(name)",
        "tickets": "closed * id + datediff(time_begin, date'1998-06-15') * 10000 + " + minutes,
        "patient_journals": "id_patient",
    }

    def text_sum(name: str):
        """Sum of the first 32 bits of each row's digest; null reads as `-`."""
        texts = [F.coalesce(F.col(f.name).cast("string"), F.lit("-")) for f in TABLES[name].schema]
        digest = F.substring(F.md5(F.concat_ws("|", *texts)), 1, 8)
        return F.sum(F.conv(digest, 16, 10).cast("long"))

    return quality.stack(
        getattr(made, name).agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.expr(value).cast("long")).alias("value_sum"),
            text_sum(name).alias("text_sum"),
        )
        for name, value in values.items()
    )


def _generators() -> dict[str, Query]:
    return {
        "scalar_functions": _scalars,
        "slot_calendar": _calendar_days,
        "generate_clinic": _generated,
    }


def _bulk() -> dict[str, Query]:
    """Reads for tables of parameters that Spark takes from the data, some of them null."""

    def some(df: DataFrame, **columns: str) -> DataFrame:
        return df.select(*(F.expr(v).alias(k) for k, v in columns.items()))

    return {
        "bulk_towns": lambda c: bulk.towns(c, some(c.towns, p_region="nullif(id_region, 2)")),
        "bulk_specialities": lambda c: bulk.specialities(
            c, some(c.specialities, p_age_group="nullif(id_age_group, 2)"), semantics="intended"
        ),
        "bulk_hospitals": lambda c: bulk.hospitals(
            c,
            EVENING,
            some(c.doctor_specialty, p_speciality="nullif(id_speciality, 3)", p_status="nullif(id % 3, 2)"),
        ),
        "bulk_doctors": lambda c: bulk.doctors(c, some(c.hospitals, p_hospital="nullif(id, 1)")),
        "bulk_tickets": lambda c: bulk.tickets(c, NOON, some(c.doctors, p_doctor="nullif(id, 1)")),
        "bulk_work_times": lambda c: bulk.work_times(
            c, some(c.hospital_work_times, p_hospital="nullif(id_hospital, 1)", p_week_day="nullif(id_week_day, 7)")
        ),
        "bulk_journals": lambda c: bulk.journals(c, some(c.requests, p_patient="nullif(id_patient, 5)")),
    }


def registered() -> dict[str, Query]:
    return _bulk() | _reads() | _bookings() | _checks() | _generators()


_NOON = "timestamp_ntz'1998-06-15 14:30:00'"
_EVENING = "timestamp_ntz'1998-06-15 16:30:00'"
SQL_CALLS = {
    "sql_towns_by_region": "get_towns_by_region(1)",
    "sql_specialities_with_doctors": "get_doctors_by_specialty(p_age_group => 1)",
    "sql_hospitals_by_speciality": f"get_hospitals_by_speciality(as_of => {_EVENING})",
    "sql_hospitals_by_speciality_filtered": f"get_hospitals_by_speciality(5, 1, {_EVENING})",
    "sql_doctors_by_hospital": "get_doctors_by_hospital(p_area => 'area 2')",
    "sql_tickets_by_doctor": f"get_tickets_by_doctor(1, {_NOON})",
    "sql_documents_by_patient": "get_documents_by_patient(p_id_patient => 4)",
    "sql_documents_by_patient_type": "get_documents_by_patient(4, p_id_document_type => 4)",
    "sql_hospital_work_time": "get_hospitals_work_time(p_id_hospital => 1)",
    "sql_hospital_work_time_day": "get_hospitals_work_time(p_id_week_day => 3)",
    # The same functions by the rules as described.
    "sql_intended_specialities": "get_doctors_by_specialty_intended(p_age_group => 1)",
    "sql_intended_hospitals": f"get_hospitals_by_speciality_intended(as_of => {_EVENING})",
    "sql_intended_hospitals_filtered": f"get_hospitals_by_speciality_intended(5, 1, {_EVENING})",
    "sql_intended_hospitals_sunday": "get_hospitals_by_speciality_intended("
    f"as_of => {_EVENING}, p_week_start => 7)",
    "sql_intended_doctors": "get_doctors_by_hospital_intended(p_area => 'area 2')",
    "sql_intended_documents": "get_documents_by_patient_intended(4, 2)",
    "sql_patient_journal": "get_patient_journald_by_patient_id()",
    # Functions called for each row of a table, some of them with null.
    "sql_each_region": "(SELECT DISTINCT nullif(id_region, 2) AS p_region FROM towns), "
    "LATERAL get_towns_by_region(p_region)",
    "sql_each_doctor": "(SELECT DISTINCT nullif(id, 1) AS p_doctor FROM doctors), "
    f"LATERAL get_tickets_by_doctor(p_doctor, {_NOON})",
    "sql_each_patient": "(SELECT DISTINCT nullif(id_patient, 5) AS p_patient FROM patient_journals), "
    "LATERAL get_patient_journald_by_patient_id(p_patient)",
}


def _by_sql(call: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = spark.newSession()  # its views and functions stay apart from the caller's
        for key, value in spark.conf.getAll.items():
            if spark.conf.isModifiable(key):
                own.conf.set(key, value)
        register(own, star_clinic(own, sf_dir))
        return own.sql(f"SELECT * FROM {call}")

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on_star(query: Query):
        return lambda spark, sf_dir: query(star_clinic(spark, sf_dir))

    found = {name: on_star(query) for name, query in registered().items()}
    return found | {name: _by_sql(call) for name, call in SQL_CALLS.items()}
