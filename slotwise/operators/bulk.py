"""The reads for whole tables of parameters.

`params` has one column per parameter; null means that the parameter is not given. Each read
returns its rows once for every different row of `params`, with the parameters beside them, so
callers with equal parameters share an answer: join it back on the parameters, null safe.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions.clock import clock_text
from slotwise.operators import reads
from slotwise.plans.skew import hot_keys, spread_join
from slotwise.sources.clinic import Clinic, tickets_after


def matching(rows: DataFrame, params: DataFrame, keys: Mapping[str, str], spread_by: str) -> DataFrame:
    """`rows` for each different row of `params`; `keys` gives the column of each parameter.

    Parameters are grouped by which of them are null, and each group is one equi-join on the
    others, in which a value that very many rows share is spread by `spread_by`; no join needs
    an "or". A row of parameters without any value takes all rows, once. Parameter columns are
    named as in `keys` and come first.
    """
    params = params.select(*keys).distinct()
    inner = {p: f"_key_{p}" for p in keys}
    found = []
    for given in product((True, False), repeat=len(keys)):
        used = [p for p, yes in zip(keys, given, strict=True) if yes]
        rest = [p for p in keys if p not in used]
        conditions = [F.col(p).isNotNull() for p in used] + [F.col(p).isNull() for p in rest]
        own = params.filter(reduce(lambda a, b: a & b, conditions))
        kind = {p: params.schema[p].dataType for p in keys}
        values = {p: F.col(inner[p]) if p in used else F.lit(None) for p in keys}
        columns = [values[p].cast(kind[p]).alias(p) for p in keys] + list(rows.columns)
        if not used:
            asked = own.agg(F.count(F.lit(1))).scalar() > 0
            found.append(rows.filter(asked).select(*columns))
            continue
        named = own.select(*(F.col(p).cast("long").alias(inner[p]) for p in used))
        keyed = rows.withColumns({inner[p]: F.col(keys[p]).cast("long") for p in used})
        on = [inner[p] for p in used]
        (hot,) = hot_keys(keyed, on)
        found.append(spread_join(keyed, named, on, hot, spread_by).select(*columns))
    return reduce(DataFrame.unionByName, found)


def towns(clinic: Clinic, params: DataFrame) -> DataFrame:
    """Parameter `p_region`."""
    return matching(clinic.towns, params, {"p_region": "id_region"}, "id")


def specialities(clinic: Clinic, params: DataFrame, *, semantics: str = "literal") -> DataFrame:
    """Parameter `p_age_group`."""
    rows = reads.specialities_with_doctors(clinic, semantics=semantics)
    return matching(rows, params, {"p_age_group": "id_age_group"}, "id")


def hospitals(clinic: Clinic, as_of: dt.datetime, params: DataFrame) -> DataFrame:
    """Parameters `p_speciality` and `p_status`; literal semantics, without an order.

    Doctor links are counted per speciality and hospital once, for all parameters together; a
    parameter row without a speciality takes the counts over all of them.
    """
    links = (
        clinic.doctors.select(F.col("id").alias("id_doctor"), "id_hospital")
        .join(clinic.doctor_specialty.select("id_doctor", "id_speciality"), "id_doctor")
        .groupBy("id_hospital", "id_speciality")
        .agg(F.count(F.lit(1)).alias("links"))
    )
    hours = (
        clinic.hospital_work_times.filter(F.col("end_time") > clock_text(as_of))
        .groupBy("id_hospital", "end_time")
        .agg(F.count(F.lit(1)).alias("days"))
    )
    columns = ["id", "id_type", "name", "id_organization", "status", "doc_count"]
    by_speciality = (
        reads.live(clinic.hospitals)
        .withColumnRenamed("id", "id_hospital")
        .join(links, "id_hospital")
        .join(hours, "id_hospital")
        .withColumn("doc_count", F.col("links") * F.col("days"))
        .withColumnRenamed("id_hospital", "id")
    )
    keys = {"p_speciality": "id_speciality", "p_status": "status"}
    named = params.filter("p_speciality IS NOT NULL")
    one = matching(by_speciality, named, keys, "id").select(*keys, *columns)
    every = reads.hospitals_by_speciality(clinic, as_of).select(*columns)
    others = params.filter("p_speciality IS NULL")
    rest = matching(every, others, {"p_status": "status"}, "id")
    nothing = F.lit(None).cast(params.schema["p_speciality"].dataType).alias("p_speciality")
    return one.unionByName(rest.select(nothing, "p_status", *columns))


def doctors(clinic: Clinic, params: DataFrame) -> DataFrame:
    """Parameter `p_hospital`; without an order, so an area makes no difference."""
    rows = reads.doctors_by_hospital(clinic)
    return matching(rows, params, {"p_hospital": "id_hospital"}, "id")


def tickets(clinic: Clinic, as_of: dt.datetime, params: DataFrame) -> DataFrame:
    """Parameter `p_doctor`."""
    links = clinic.doctor_specialty.select(F.col("id").alias("id_doctor_speciality"), "id_doctor")
    ahead = tickets_after(clinic.tickets, as_of)
    rows = ahead.join(links, "id_doctor_speciality").select(*ahead.columns, "id_doctor")
    return matching(rows, params, {"p_doctor": "id_doctor"}, "id").drop("id_doctor")


def work_times(clinic: Clinic, params: DataFrame) -> DataFrame:
    """Parameters `p_hospital` and `p_week_day`."""
    keys = {"p_hospital": "id_hospital", "p_week_day": "id_week_day"}
    return matching(clinic.hospital_work_times, params, keys, "id")


def journals(clinic: Clinic, params: DataFrame) -> DataFrame:
    """Parameter `p_patient`."""
    return matching(clinic.patient_journals, params, {"p_patient": "id_patient"}, "id_ticket")
