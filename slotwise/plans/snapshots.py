"""New table states from a stored state and a set of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.plans.lineage import durable

PAIR = ["id_patient", "id_ticket"]


def journal_snapshot(journals: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert of `changes` (pair, new_status), at most one per pair.

    Known pairs take their status by a left join and new ones are added to them, so the journal
    keeps its place: the stored changes are of known size and are broadcast if that is small,
    and a journal in buckets by pair meets larger ones without being moved.
    """
    changes = durable(changes)
    known = journals.join(changes, PAIR, "left_semi").select(*PAIR)
    new = changes.join(known, PAIR, "left_anti")
    kept = journals.join(changes, PAIR, "left").select(
        *PAIR, F.coalesce("new_status", "status").alias("status")
    )
    return kept.unionByName(new.select(*PAIR, F.col("new_status").alias("status")))


def ticket_snapshot(tickets: DataFrame, changes: DataFrame) -> DataFrame:
    """Tickets with `new_closed` of `changes` (id_ticket, new_closed) where given."""
    columns = tickets.columns
    changes = durable(changes)
    return (
        tickets.join(changes, tickets["id"] == changes["id_ticket"], "left")
        .withColumn("closed", F.coalesce("new_closed", "closed"))
        .select(*columns)
    )
