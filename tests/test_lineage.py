import os
import random

import pytest
from test_booking import AS_OF, base, random_log

from slotwise.operators import booking
from slotwise.plans import asof, lineage
from slotwise.sources.schemas import LOG


def kept(spark):
    folder = lineage.shared_folder(spark).removeprefix("file:")
    return {n for n in os.listdir(folder) if n.startswith("slotwise-")}


def test_rounds_leave_only_the_last_of_their_stored_rows(spark):
    before = kept(spark)
    steps = spark.createDataFrame([(i, i + 1) for i in range(40)], "seq long, target long")
    found = asof.reached(spark.createDataFrame([(0,)], "seq long"), steps)
    assert sorted(r.seq for r in found.collect()) == list(range(41))
    assert kept(spark) - before == {os.path.basename(found._durable_path)}


@pytest.mark.parametrize("semantics, stored", [("intended", 2), ("literal", 1)])
def test_a_log_keeps_only_what_its_result_reads(spark, make_clinic, semantics, stored):
    """Of the intended log the calls and the last round, of the literal one the last round."""
    clinic = make_clinic(**base(patient_journals=[dict(id_patient=1, id_ticket=1, status=1)]))
    log = spark.createDataFrame(random_log(random.Random(3), 60, 5, 2), LOG)
    before = kept(spark)
    decisions = booking.booking_log(clinic, log, AS_OF, semantics=semantics)
    assert decisions.count() == 60 and len(kept(spark) - before) == stored
