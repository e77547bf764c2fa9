"""Batches as feeds send them."""

import decimal

import pytest
from conftest import rows

from slotwise.sources.calls import call_faults, checked_calls, typed_calls
from slotwise.sources.schemas import LOG, REQUESTS


def faults(df, schema):
    return {r.fault: r.n_rows for r in call_faults(df, schema).collect() if r.n_rows}


def test_numbers_from_text(spark):
    given = ["7", " 8 ", "9.0", "1e1", "2.5", "x", "", None, "9223372036854775807", "9223372036854775808"]
    df = spark.createDataFrame([(i, v, v) for i, v in enumerate(given)], "seq int, id_patient string, id_ticket string")
    wanted = [7, 8, 9, 10, None, None, None, None, 2**63 - 1, None]
    typed = typed_calls(df, REQUESTS)
    assert [r.id_patient for r in typed.orderBy("seq").collect()] == wanted
    assert [f.dataType for f in typed.schema] == [f.dataType for f in REQUESTS]
    bad = sum(v is None for v in wanted) - 1  # a null id is no fault
    assert faults(df, REQUESTS) == {f"{c} is no whole number": bad for c in ("id_patient", "id_ticket")}
    with pytest.raises(ValueError, match="id_patient is no whole number: 4"):
        checked_calls(df, REQUESTS)


def test_numbers_of_other_types(spark):
    df = spark.createDataFrame(
        [(1, 3.0, decimal.Decimal("4.00")), (2, float("nan"), decimal.Decimal("4.50")), (3, None, None), (4, 1e300, None)],
        "seq short, id_patient double, id_ticket decimal(10,2)",
    )
    typed = typed_calls(df, REQUESTS).orderBy("seq")
    assert rows(typed, "id_patient", "id_ticket") == [(3, 4), (None, None), (None, None), (None, None)]
    assert faults(df, REQUESTS) == {"id_patient is no whole number": 2, "id_ticket is no whole number": 1}


def test_places_and_kinds_of_calls(spark):
    calls = [(1, "request"), (1, "request"), (1, "cancel"), (None, "cancel"), (None, None), (2, "move"), (3, "cancel")]
    df = spark.createDataFrame([(s, op, 1, 1, "more") for s, op in calls], "seq long, op string, id_patient int, id_ticket int, note string")
    assert faults(df, LOG) == {"seq is missing": 2, "seq is repeated": 2, "op is unknown": 2}
    good = checked_calls(df.filter("seq = 3"), LOG)
    assert rows(good, *LOG.names) == [(3, "cancel", 1, 1)] and good.columns == LOG.names


def test_empty_and_incomplete_batches(spark):
    df = spark.createDataFrame([], "seq long, id_patient string, id_ticket long")
    assert faults(df, REQUESTS) == {} and call_faults(df, REQUESTS).count() == 4
    assert checked_calls(df, REQUESTS).count() == 0
    for ask in (typed_calls, call_faults):
        with pytest.raises(ValueError, match="no column id_ticket"):
            ask(df.drop("id_ticket"), REQUESTS)
