"""Timings of the headline queries; prints one JSON line.

The star-schema tables are turned into stored clinic tables once ("ingest"); the queries then
run on the stored tables, as they would on a cluster, and write to the no-op sink. Every
query runs twice; the faster time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slotwise import Clinic  # noqa: E402
from slotwise.plans.lineage import shared_folder  # noqa: E402
from slotwise.queries import registered  # noqa: E402
from slotwise.session import local_session  # noqa: E402
from slotwise.sources.star import star_clinic  # noqa: E402

INPUTS = ("requests", "cancels", "booking_log", "order_lines")
HEADLINE = """
    specialities_with_doctors_literal specialities_with_doctors_intended
    hospitals_by_speciality_literal hospitals_by_speciality_intended
    hospitals_by_speciality_literal_pos doctors_by_hospital_literal
    tickets_by_doctor tickets_all_doctors documents_by_patients_intended
    hospital_work_time_all patient_journal_all
    booking_eligibility booking_decisions_literal booking_decisions_intended
    journal_after_booking_intended tickets_after_booking_intended
    cancel_decisions journal_after_cancel tickets_after_cancel booking_log
    dq_unique dq_foreign_key dq_not_null dq_domain slot_calendar
""".split()


def stored_clinic(spark, sf_dir: str) -> Clinic:
    """Domain tables and call batches of `sf_dir`, written as Parquet and opened again."""
    root = f"{shared_folder(spark)}/bench-{uuid.uuid4().hex}"
    star = star_clinic(spark, sf_dir)
    star.write(root)
    tables = {}
    for name in INPUTS:
        df = getattr(star, name)
        df.write.parquet(f"{root}/{name}")
        tables[name] = spark.read.schema(df.schema).parquet(f"{root}/{name}")
    return Clinic.read(spark, root).replace(**tables)


def seconds(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = sys.argv[1:]
    spark = local_session()
    start = time.perf_counter()
    clinic = stored_clinic(spark, sf_dir)
    times = {"ingest": round(time.perf_counter() - start, 3)}
    queries = registered()
    for name in only or HEADLINE:
        query = queries[name]
        best = min(seconds(lambda: query(clinic)) for _ in range(2))
        times[name] = round(best, 3)
    line = {
        "metric": "headline queries, total time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
