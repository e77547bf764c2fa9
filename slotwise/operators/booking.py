"""Booking and cancelling in batches.

A batch is a table (seq, id_patient, id_ticket) of calls made in the order of the unique
`seq`, all at one moment `as_of`. Decisions come back as the same rows with `accepted`;
snapshots of tickets and journal follow from the decisions.

A call on one ticket may be asked by very many patients and one patient may ask for very
many tickets, so both lookups are joined with hot keys spread, and repeated pairs are
merged before the journal is consulted.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.clock import age_within, clock_text, week_day
from slotwise.operators.reads import live
from slotwise.plans.asof import nearest, reached
from slotwise.plans.lineage import durable, forget
from slotwise.plans.ranking import ID_RANGE, count_before
from slotwise.plans.skew import hot_keys, spread_join
from slotwise.plans.snapshots import PAIR, journal_snapshot, ticket_snapshot
from slotwise.sources.clinic import SLOT_MONTH, Clinic, read_table, tickets_after, write_table
from slotwise.sources.versions import store_version

POLICY = 4  # document type of the health policy
BOOKED = 0
CANCELLED = 1
MIN_LONG = -(2**63)
TICKET = ["id_ticket"]
PATIENT = ["id_patient"]


def _tickets_ahead(clinic: Clinic, as_of: dt.datetime) -> DataFrame:
    return tickets_after(clinic.tickets, as_of).select(
        F.col("id").alias("id_ticket"), "id_doctor_speciality", "closed"
    )


def _slots(clinic: Clinic, tickets: DataFrame) -> DataFrame:
    """Tickets of live doctors, hospitals and specialities with whom they are for.

    The allowed genders of a speciality become one array (as long as the gender table), so
    the gender rule needs no further join on the side of the requests.
    """
    hospitals = live(clinic.hospitals).select(F.col("id").alias("id_hospital"))
    doctors = live(clinic.doctors).join(hospitals, "id_hospital", "left_semi")
    genders = clinic.speciality_gender.groupBy("id_speciality").agg(
        F.collect_set("id_gender").alias("genders")
    )
    ages = clinic.age_groups.select(
        F.col("id").alias("id_age_group"), "age_begin", "age_end"
    )
    specialities = (
        live(clinic.specialities)
        .select(F.col("id").alias("id_speciality"), "id_age_group")
        .join(ages, "id_age_group")
        .join(genders, "id_speciality")
    )
    links = clinic.doctor_specialty.withColumnRenamed("id", "id_doctor_speciality").join(
        doctors.select(F.col("id").alias("id_doctor")), "id_doctor", "left_semi"
    )
    # One speciality may be that of very many doctors.
    speciality = ["id_speciality"]
    (hot,) = hot_keys(clinic.doctor_specialty, speciality)
    links = spread_join(links, specialities, speciality, hot, "id_doctor_speciality")
    links = links.select("id_doctor_speciality", "age_begin", "age_end", "genders")
    return tickets.join(links, "id_doctor_speciality").drop("id_doctor_speciality")


def _insured(clinic: Clinic) -> DataFrame:
    """Patients with their number of health policies, at least one."""
    policies = (
        clinic.patient_documents.filter(F.col("id_document_type") == POLICY)
        .groupBy("id_patient")
        .agg(F.count(F.lit(1)).alias("policies"))
    )
    patients = clinic.patients.select(
        F.col("id").alias("id_patient"), "birthdate", "id_gender"
    )
    return patients.join(policies, "id_patient")


def _fitting(
    clinic: Clinic,
    calls: DataFrame,
    tickets: DataFrame,
    as_of: dt.datetime,
    hot_tickets: list[int],
    hot_patients: list[int],
) -> DataFrame:
    """Calls whose patient may take the ticket, with `policies` and the ticket's `closed`.

    Keys are unique in every table joined here, so the number of rows that the plain join
    of all tables has for a call is the number of policies of its patient.
    """
    asked = spread_join(calls, _slots(clinic, tickets), TICKET, hot_tickets, "seq")
    known = spread_join(asked, _insured(clinic), PATIENT, hot_patients, "seq")
    age = age_within(F.col("birthdate"), F.col("age_begin"), F.col("age_end"), as_of)
    gender = F.array_contains("genders", F.col("id_gender"))
    return known.filter(age & gender).select(*calls.columns, "policies", "closed")


def _fits(semantics: str) -> Column:
    """Literal: exactly one joined row, so a second policy refuses the patient."""
    if semantics not in ("literal", "intended"):
        raise ValueError(f"semantics is 'literal' or 'intended', not {semantics!r}")
    policies = F.col("policies")
    return policies == 1 if semantics == "literal" else policies >= 1


def _open_fitting(clinic, requests, as_of, hot_tickets, hot_patients) -> DataFrame:
    open_tickets = _tickets_ahead(clinic, as_of).filter(F.col("closed") == 0)
    return _fitting(clinic, requests, open_tickets, as_of, hot_tickets, hot_patients)


def _booked(clinic: Clinic) -> DataFrame:
    return clinic.patient_journals.filter(F.col("status") == BOOKED).select(*PAIR)


def _with_accepted(calls: DataFrame, accepted: DataFrame) -> DataFrame:
    """All calls with the flag; `seq` is unique on both sides, so no key is hot."""
    hits = accepted.select("seq", F.lit(True).alias("accepted"))
    return calls.join(hits, "seq", "left").select(
        *calls.columns, F.coalesce("accepted", F.lit(False)).alias("accepted")
    )


def booking_eligibility(
    clinic: Clinic, requests: DataFrame, as_of: dt.datetime
) -> DataFrame:
    """Per request, against the tables as they are: what the checks of a call see.

    `match_count` is the number of joined rows, `already_booked` an active booking of the
    pair.
    """
    *hot, hot_pairs = hot_keys(requests, TICKET, PATIENT, PAIR)
    matches = _open_fitting(clinic, requests, as_of, *hot).select(
        "seq", F.col("policies").alias("match_count")
    )
    booked = _booked(clinic).withColumn("already_booked", F.lit(True))
    counted = requests.join(matches, "seq", "left")
    return spread_join(counted, booked, PAIR, hot_pairs, "seq", "left").select(
        "seq",
        *PAIR,
        F.coalesce("match_count", F.lit(0)).cast("long").alias("match_count"),
        F.coalesce("already_booked", F.lit(False)).alias("already_booked"),
    )


def booking_decisions(
    clinic: Clinic, requests: DataFrame, as_of: dt.datetime, *, semantics: str = "literal"
) -> DataFrame:
    """Which requests of a batch are accepted.

    The first fitting request of an open ticket wins it, since accepting closes the
    ticket. A pair with an active booking is refused.

    Literal adds the side effect of an acceptance: every journal row becomes active. So
    the first request accepted at all may revive its cancelled booking, and later ones
    may only come from pairs without any journal row.
    """
    hot = hot_keys(requests, TICKET, PATIENT)
    fitting = _open_fitting(clinic, requests, as_of, *hot).filter(_fits(semantics))
    # Calls of one pair differ in nothing but their place, so only the first can win.
    firsts = fitting.groupBy(*PAIR).agg(F.min("seq").alias("seq"))
    if semantics == "intended":
        able = firsts.join(_booked(clinic), PAIR, "left_anti")
    else:
        noted = clinic.patient_journals.select(*PAIR, F.col("status").alias("_status"))
        able = firsts.join(noted, PAIR, "left").filter(
            F.col("_status").isNull() | (F.col("_status") != BOOKED)
        )
        able = durable(able)  # read twice below
        first = able.agg(F.min("seq")).scalar()
        able = able.filter(F.col("_status").isNull() | (F.col("seq") == first))
    winners = able.groupBy("id_ticket").agg(F.min("seq").alias("seq"))
    return _with_accepted(requests, winners)


def journal_after_booking(
    clinic: Clinic, decisions: DataFrame, *, semantics: str = "literal"
) -> DataFrame:
    """Journal after a batch.

    Literal: any acceptance makes all rows active and inserts none. Intended: accepted
    pairs are added, or become active again.
    """
    if semantics == "literal":
        any_accepted = decisions.agg(F.max("accepted")).scalar()
        status = F.when(any_accepted, BOOKED).otherwise(F.col("status")).cast("int")
        return clinic.patient_journals.withColumn("status", status)
    changes = decisions.filter("accepted").select(
        *PAIR, F.lit(BOOKED).alias("new_status")
    )
    return journal_snapshot(clinic.patient_journals, changes)


def _ticket_changes(decisions: DataFrame, kind: str) -> DataFrame:
    """(id_ticket, new_closed) of the accepted calls, one per ticket."""
    done = decisions.filter("accepted")
    if kind == "log":
        last = done.groupBy("id_ticket").agg(_last_op().alias("_op"))
        closed = F.when(F.col("_op") == "cancel", 0).otherwise(1)
        return last.select("id_ticket", closed.alias("new_closed"))
    closed = F.lit(1 if kind == "booking" else 0)
    return done.select("id_ticket").distinct().withColumn("new_closed", closed)


def tickets_after_booking(clinic: Clinic, decisions: DataFrame) -> DataFrame:
    """Accepted tickets are closed."""
    return ticket_snapshot(clinic.tickets, _ticket_changes(decisions, "booking"))


def _cancellable(clinic: Clinic, as_of: dt.datetime, week_start: int) -> DataFrame:
    """Tickets ahead whose hospital closes today later than two hours from now.

    Closing hours compare as clock text, so shortly before midnight the two hours wrap
    around and every hospital passes. Weekday and hospital are a key of the opening hours:
    a hospital is found once or not at all, and semi joins do.
    """
    limit = clock_text(as_of + dt.timedelta(hours=2))
    hospitals = clinic.hospital_work_times.filter(
        (F.col("id_week_day") == week_day(as_of, week_start))
        & (F.col("end_time") > limit)
    ).select("id_hospital")
    doctors = clinic.doctors.select(F.col("id").alias("id_doctor"), "id_hospital").join(
        hospitals, "id_hospital", "left_semi"
    )
    links = clinic.doctor_specialty.join(doctors, "id_doctor", "left_semi").select(
        F.col("id").alias("id_doctor_speciality")
    )
    return _tickets_ahead(clinic, as_of).join(links, "id_doctor_speciality", "left_semi")


def cancel_decisions(
    clinic: Clinic, cancels: DataFrame, as_of: dt.datetime, *, week_start: int = 1
) -> DataFrame:
    """Which cancels of a batch are accepted: the first of each pair with an active booking
    of a ticket that may still be cancelled."""
    (hot_tickets,) = hot_keys(cancels, TICKET)
    firsts = cancels.groupBy(*PAIR).agg(F.min("seq").alias("seq"))
    held = firsts.join(_booked(clinic), PAIR, "left_semi")
    tickets = _cancellable(clinic, as_of, week_start).select("id_ticket")
    accepted = spread_join(held, tickets, TICKET, hot_tickets, "seq", "left_semi")
    return _with_accepted(cancels, accepted)


def journal_after_cancel(clinic: Clinic, decisions: DataFrame) -> DataFrame:
    """Accepted pairs become cancelled."""
    changes = decisions.filter("accepted").select(
        *PAIR, F.lit(CANCELLED).alias("new_status")
    )
    return journal_snapshot(clinic.patient_journals, changes)


def tickets_after_cancel(clinic: Clinic, decisions: DataFrame) -> DataFrame:
    """Accepted tickets are open again, also when another patient still holds them."""
    return ticket_snapshot(clinic.tickets, _ticket_changes(decisions, "cancel"))


def booking_log(
    clinic: Clinic,
    log: DataFrame,
    as_of: dt.datetime,
    *,
    week_start: int = 1,
    semantics: str = "intended",
) -> DataFrame:
    """Decisions for requests and cancels mixed in one order.

    Literal: see `_literal_log`. Intended: whether patient and ticket fit does not change during a batch and is decided by joins
    first. What is left depends on the earlier calls for the same ticket only. A ticket
    without a cancel that could succeed goes to its first free request, an aggregate. For
    the others, calls that cannot succeed whatever happened before are taken out by
    aggregates, and the rest is chained from cancel to request.
    """
    if semantics == "literal":
        return _with_accepted(log, _literal_log(clinic, log, as_of, week_start))
    if semantics != "intended":
        raise ValueError(f"semantics is 'literal' or 'intended', not {semantics!r}")
    hot_tickets, hot_patients, hot_pairs = hot_keys(log, TICKET, PATIENT, PAIR)
    is_request, is_cancel = F.col("op") == "request", F.col("op") == "cancel"
    ahead = _tickets_ahead(clinic, as_of)
    asked = log.filter(is_request)
    requests = _fitting(clinic, asked, ahead, as_of, hot_tickets, hot_patients)
    open_tickets = _cancellable(clinic, as_of, week_start).select("id_ticket", "closed")
    cancels = spread_join(log.filter(is_cancel), open_tickets, TICKET, hot_tickets, "seq")
    # The few calls that pass are read several times from here on.
    calls = durable(requests.drop("policies").unionByName(cancels))

    # A cancel needs a booking: one from before the batch or an earlier request. Right after
    # another cancel of the pair it cannot succeed; that is looked up within a range of call
    # numbers, which takes out all but one of a long row of them.
    pairs = (
        calls.groupBy(*PAIR)
        .agg(F.min(F.when(is_request, F.col("seq"))).alias("_asked"))
        .join(_booked(clinic).withColumn("_held", F.lit(True)), PAIR, "left")
        .select(*PAIR, "_asked", F.coalesce("_held", F.lit(False)).alias("_held"))
        .filter(F.col("_held") | F.col("_asked").isNotNull())
    )
    nearby = Window.partitionBy(*PAIR, F.floor(F.col("seq") / ID_RANGE)).orderBy("seq")
    passed, calls = calls, durable(
        spread_join(calls, pairs, PAIR, hot_pairs, "seq")
        .filter(is_request | F.col("_held") | (F.col("_asked") < F.col("seq")))
        .withColumn("_previous", F.lag("op").over(nearby))
        .filter(is_request | (F.coalesce("_previous", F.lit("")) != "cancel"))
        .withColumn("_new", ~F.col("_held") & F.equal_null("_asked", "seq"))
        .select("seq", "op", *PAIR, "closed", "_held", "_new")
    )
    forget(passed)
    cancels, requests = calls.filter(is_cancel), calls.filter(is_request)
    contested = cancels.select("id_ticket").distinct()
    winners = (
        spread_join(requests, contested, TICKET, hot_tickets, "seq", "left_anti")
        .filter((F.col("closed") == 0) & ~F.col("_held"))
        .groupBy("id_ticket")
        .agg(F.min("seq").alias("seq"))
    )

    # Between two useful cancels at most one request is accepted, at the latest the first
    # one of a patient who never had or asked for the ticket before.
    disputed = spread_join(requests, contested, TICKET, hot_tickets, "seq", "left_semi")
    both = disputed.unionByName(cancels)
    rounds = durable(
        count_before(both, is_cancel, TICKET, "seq", "_round")
        .filter(is_request)
        .select(*PAIR, "seq", "closed", "_held", "_new", "_round")
    )
    a_round = [*TICKET, "_round"]
    newcomers = _first_requests(rounds.filter("_new"), a_round)
    repeats = _first_requests(rounds.filter("NOT _new"), [*a_round, "id_patient"])
    limits = newcomers.select(*a_round, F.col("seq").alias("_limit"))
    repeats = spread_join(
        repeats, limits, a_round, hot_tickets, "seq", "left", hot_on=TICKET
    ).filter(F.col("_limit").isNull() | (F.col("seq") < F.col("_limit")))

    parts = (cancels, newcomers, repeats)
    followed = _chained(*(df.select(*PAIR, "seq", "closed", "op", "_held") for df in parts))
    forget(rounds)
    return _with_accepted(log, winners.select("seq").unionByName(followed))


def _first_requests(requests: DataFrame, by: list[str]) -> DataFrame:
    """The first request of each group; numbers only, so a hash aggregate combines them."""
    rest = [c for c in (*PAIR, "closed", "_held") if c not in by]
    firsts = [F.min_by(c, "seq").alias(c) for c in rest]
    found = requests.groupBy(*by).agg(F.min("seq").alias("seq"), *firsts)
    return found.withColumn("op", F.lit("request"))


def _chained(*calls: DataFrame) -> DataFrame:
    """Accepted `seq` of the contested tickets' calls, without following them one by one.

    A cancel ends what its patient holds, so an accepted request lasts until the patient's next
    cancel, and right after a cancel that succeeds the ticket goes to the next request of a
    patient who does not hold it. Both are found for every request whether it is accepted or
    not: a request has one successor, and those accepted are what the successors lead to from
    the start (an open ticket, the first cancels of the holders from before). They compose, so
    one ticket's calls are spread like any others.

    Who holds the ticket already cannot ask again; that depends on the accepted requests
    before, so it is taken from the round before until it changes nothing. Each round is right
    at least up to the first call that the round before had wrong, and where a ticket has one
    holder at a time, the second round changes nothing that matters.
    """
    is_request, is_cancel = F.col("op") == "request", F.col("op") == "cancel"
    rows = calls[0]
    for more in calls[1:]:
        rows = rows.unionByName(more)
    cancel = F.when(is_cancel, F.col("seq"))
    rows = nearest(rows, cancel, PAIR, "seq", "_cancel_before")
    rows = nearest(rows, cancel, PAIR, "seq", "_cancel_after", after=True)
    early = F.col("_held") & F.col("_cancel_before").isNull()
    stored = rows = durable(rows.withColumn("_blocked", is_request & early))
    while True:
        able = F.when(is_request & ~F.col("_blocked"), F.col("seq"))
        led = durable(nearest(rows, able, TICKET, "seq", "_next", after=True))
        first = (
            led.filter((F.col("closed") == 0) & is_request & ~F.col("_blocked"))
            .groupBy(*TICKET)
            .agg(F.min("seq").alias("seq"))
            .select("seq")
        )
        freed = led.filter(is_cancel & early & F.col("_next").isNotNull())
        ends = led.filter(is_cancel).select(F.col("seq").alias("_cancel_after"), F.col("_next").alias("target"))
        steps = led.filter(is_request).join(ends, "_cancel_after").select("seq", "target")
        won = reached(first.union(freed.select(F.col("_next").alias("seq"))), steps)
        rows = rows.drop("_won").join(won.withColumn("_won", F.lit(True)), "seq", "left")
        rows = rows.withColumn("_won", F.coalesce("_won", F.lit(False)))
        asked = nearest(rows, F.when(F.col("_won"), F.col("seq")), PAIR, "seq", "_won_before")
        holds = F.coalesce(F.col("_won_before") > F.coalesce("_cancel_before", F.lit(MIN_LONG)), F.lit(False))
        again = durable(
            asked.withColumn("_held_now", holds | early)
            .withColumn("_was", F.col("_blocked"))
            .withColumn("_blocked", is_request & F.col("_held_now"))
        )
        forget(stored, led, won)
        stored = again
        if again.filter(F.col("_was") != F.col("_blocked")).isEmpty():
            useful = F.col("_won") | (is_cancel & F.col("_held_now"))
            return again.filter(useful).select("seq")
        rows = again.drop("_held_now", "_was", "_won_before")


def _literal_log(
    clinic: Clinic, log: DataFrame, as_of: dt.datetime, week_start: int
) -> DataFrame:
    """Accepted `seq` of a mixed log as written: an acceptance makes every journal row active
    and adds none.

    So a pair of the journal is active at a call if some request was accepted, whoever's, since
    the pair's last cancel before the call, and pairs without a row can neither be active nor
    cancel. Given which requests are accepted, the status of each call and then its decision
    follow from the nearest calls before it; the rounds begin with all requests that fit and
    end when nothing changes. Each round is right at least up to the first call that the round
    before had wrong.
    """
    hot_tickets, hot_patients, hot_pairs = hot_keys(log, TICKET, PATIENT, PAIR)
    is_request, is_cancel = F.col("op") == "request", F.col("op") == "cancel"
    ahead = _tickets_ahead(clinic, as_of)
    fitting = _fitting(clinic, log.filter(is_request), ahead, as_of, hot_tickets, hot_patients)
    requests = fitting.filter(_fits("literal")).drop("policies")
    open_tickets = _cancellable(clinic, as_of, week_start).select("id_ticket", "closed")
    cancels = spread_join(log.filter(is_cancel), open_tickets, TICKET, hot_tickets, "seq")
    noted = clinic.patient_journals.select(*PAIR, (F.col("status") == BOOKED).alias("_active"))
    columns = ["seq", "op", *PAIR, "closed", "_active"]
    calls = durable(
        spread_join(requests, noted, PAIR, hot_pairs, "seq", "left")
        .select(*columns)
        .unionByName(spread_join(cancels, noted, PAIR, hot_pairs, "seq").select(*columns))
    )
    fitted = calls
    calls = nearest(calls, F.when(is_cancel, F.col("seq")), PAIR, "seq", "_cancel_before")
    stored = calls = durable(calls.withColumn("_won", is_request))
    forget(fitted)
    while True:
        reset = nearest(calls, F.when(F.col("_won"), F.col("seq")), [], "seq", "_reset")
        since = F.col("_reset") > F.col("_cancel_before")
        fresh = F.col("_active") | F.col("_reset").isNotNull()
        now = F.when(F.col("_cancel_before").isNull(), fresh).otherwise(F.coalesce(since, F.lit(False)))
        known = F.col("_active").isNotNull()
        useful = reset.withColumn("_useful", F.when(is_cancel, now).otherwise(~known | ~now))
        # The last call before that could close or open the ticket, twice its number and one
        # more for a cancel.
        mark = F.when(F.col("_useful"), F.col("seq") * 2 + is_cancel.cast("long"))
        marked = nearest(useful, mark, TICKET, "seq", "_last")
        is_open = F.coalesce(F.pmod("_last", F.lit(2)) == 1, F.col("closed") == 0)
        again = durable(
            marked.withColumn("_was", F.col("_won"))
            .withColumn("_won", is_request & F.col("_useful") & is_open)
            .drop("_last", "_reset")
        )
        forget(stored)
        stored = again
        if again.filter(F.col("_was") != F.col("_won")).isEmpty():
            return again.filter(F.col("_won") | (is_cancel & F.col("_useful"))).select("seq")
        calls = again.drop("_was", "_useful")


def journal_after_log(
    clinic: Clinic, decisions: DataFrame, *, semantics: str = "intended"
) -> DataFrame:
    """The last accepted call of a pair gives its status. Literal: a row is cancelled if its
    last accepted cancel is later than the last acceptance at all, else active if there was
    any; no row is added."""
    if semantics == "literal":
        done = decisions.filter("accepted")
        reset = done.filter(F.col("op") == "request").agg(F.max("seq")).scalar()
        ended = done.filter(F.col("op") == "cancel").groupBy(*PAIR).agg(F.max("seq").alias("_end"))
        after = F.col("_end") > F.coalesce(reset, F.lit(MIN_LONG))
        status = F.when(after, CANCELLED).when(reset.isNotNull(), BOOKED).otherwise(F.col("status"))
        joined = clinic.patient_journals.join(ended, PAIR, "left")
        return joined.select(*PAIR, status.cast("int").alias("status"))
    last = decisions.filter("accepted").groupBy(*PAIR).agg(_last_op().alias("_op"))
    status = F.when(F.col("_op") == "cancel", CANCELLED).otherwise(BOOKED)
    return journal_snapshot(
        clinic.patient_journals, last.select(*PAIR, status.alias("new_status"))
    )


def tickets_after_log(clinic: Clinic, decisions: DataFrame) -> DataFrame:
    """The last accepted call for a ticket leaves it closed or open."""
    return ticket_snapshot(clinic.tickets, _ticket_changes(decisions, "log"))


def _last_op() -> Column:
    return F.max_by("op", "seq")


def store_batch(
    clinic: Clinic,
    decisions: DataFrame,
    root: str,
    *,
    kind: str,
    semantics: str | None = None,
) -> Clinic:
    """Write the decisions and the new tickets and journal below the new folder `root`.

    The decisions are written first and read back, so both snapshots follow from the same
    stored rows whatever happens to the executors. `kind` is "booking", "cancel" or "log";
    `semantics` is that of the decisions, by default literal for bookings and intended for a
    log, as there. Of tickets stored by month only the months that change are written, see
    `versions.store_version`. Returns the clinic with the new tables.
    """
    if kind not in ("booking", "cancel", "log"):
        raise ValueError(f"unknown kind {kind!r}")
    spark = decisions.sparkSession
    decisions.write.parquet(f"{root}/decisions")
    stored = spark.read.schema(decisions.schema).parquet(f"{root}/decisions")
    if kind == "booking":
        journal = journal_after_booking(clinic, stored, semantics=semantics or "literal")
    elif kind == "cancel":
        journal = journal_after_cancel(clinic, stored)
    else:
        journal = journal_after_log(clinic, stored, semantics=semantics or "intended")
    write_table(journal, "patient_journals", f"{root}/patient_journals")
    changes = durable(_ticket_changes(stored, kind))
    if SLOT_MONTH in clinic.tickets.columns:
        tickets = store_version(clinic.tickets, changes, root)
    else:
        write_table(ticket_snapshot(clinic.tickets, changes), "tickets", f"{root}/tickets")
        tickets = read_table(spark, "tickets", f"{root}/tickets")
    journal = read_table(spark, "patient_journals", f"{root}/patient_journals")
    return clinic.replace(tickets=tickets, patient_journals=journal)
