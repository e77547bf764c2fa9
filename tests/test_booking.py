"""Bookings against exact fixtures and against plain call-by-call loops."""

import datetime as dt
import random

import pytest
from conftest import rows
from model import World

from slotwise.operators import booking
from slotwise.plans import asof, ranking, skew
from slotwise.sources.lookups import AGE_GROUPS
from slotwise.sources.schemas import LOG, REQUESTS

AS_OF = dt.datetime(2024, 5, 13, 14, 30)  # a Monday
LATER = dt.datetime(2024, 5, 20, 10, 0)
GONE = dt.datetime(2019, 3, 1)


def base(**changes):
    """One live doctor with one speciality for grown-up patients of genders 1 and 2."""
    tables = dict(
        hospitals=[dict(id=1)],
        doctors=[dict(id=1, id_hospital=1)],
        specialities=[dict(id=1, id_age_group=4)],
        doctor_specialty=[dict(id=1, id_speciality=1, id_doctor=1)],
        speciality_gender=[
            dict(id_speciality=1, id_gender=1),
            dict(id_speciality=1, id_gender=2),
        ],
        hospital_work_times=[
            dict(id=1, id_week_day=1, id_hospital=1, begin_time="08:00", end_time="18:00")
        ],
        patients=[
            dict(id=i, id_gender=i % 2 + 1, birthdate=dt.date(1980, 6, 1)) for i in range(1, 6)
        ],
        patient_documents=[
            dict(id=i, id_patient=i, id_document_type=4) for i in range(1, 6)
        ],
        tickets=[
            dict(id=i, id_doctor_speciality=1, closed=0, time_begin=LATER, time_end=LATER)
            for i in range(1, 5)
        ],
        patient_journals=[],
    )
    return tables | changes


class Batch:
    def __init__(self, spark, make_clinic, tables, as_of=AS_OF):
        self.spark, self.tables, self.as_of = spark, tables, as_of
        self.clinic = make_clinic(**tables)

    def calls(self, *calls):
        return self.spark.createDataFrame(list(calls), REQUESTS)

    def request(self, *calls, semantics="literal"):
        df = booking.booking_decisions(
            self.clinic, self.calls(*calls), self.as_of, semantics=semantics
        )
        assert df.count() == len(calls)
        return accepted(df)

    def cancel(self, *calls):
        return accepted(booking.cancel_decisions(self.clinic, self.calls(*calls), self.as_of))


def accepted(df):
    return {seq for seq, ok in rows(df, "seq", "accepted") if ok}


@pytest.fixture
def batch(spark, make_clinic):
    return lambda tables=None, as_of=AS_OF: Batch(
        spark, make_clinic, tables or base(), as_of
    )


def test_first_fitting_request_wins(batch):
    b = batch(base(patient_documents=[dict(id=i, id_patient=i, id_document_type=4) for i in (2, 3)]))
    calls = [(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 2, 1), (5, 3, 2), (6, 9, 3), (7, 2, 99)]
    for semantics in booking_semantics():
        assert b.request(*calls, semantics=semantics) == {2, 5}


def booking_semantics():
    return ("literal", "intended")


def test_second_policy_refuses_as_written(batch):
    documents = [dict(id=i, id_patient=i, id_document_type=4) for i in (1, 2)]
    documents.append(dict(id=9, id_patient=2, id_document_type=4))
    b = batch(base(patient_documents=documents))
    calls = [(1, 1, 1), (2, 2, 2), (3, 3, 3)]
    assert b.request(*calls) == {1}
    assert b.request(*calls, semantics="intended") == {1, 2}
    seen = booking.booking_eligibility(b.clinic, b.calls(*calls), AS_OF)
    assert sorted(rows(seen, "seq", "match_count", "already_booked")) == [
        (1, 1, False),
        (2, 2, False),
        (3, 0, False),
    ]


@pytest.mark.parametrize(
    "changes",
    [
        dict(hospitals=[dict(id=1, deleted_at=GONE)]),
        dict(doctors=[dict(id=1, id_hospital=1, deleted_at=GONE)]),
        dict(specialities=[dict(id=1, id_age_group=4, deleted_at=GONE)]),
        dict(specialities=[dict(id=1, id_age_group=5)]),
        dict(speciality_gender=[dict(id_speciality=1, id_gender=3)]),
        dict(patient_documents=[dict(id=1, id_patient=1, id_document_type=3)]),
        dict(tickets=[dict(id=1, id_doctor_speciality=1, closed=1, time_begin=LATER)]),
        dict(tickets=[dict(id=1, id_doctor_speciality=1, closed=0, time_begin=AS_OF)]),
        dict(patient_journals=[dict(id_patient=1, id_ticket=1, status=0)]),
    ],
)
def test_refused(batch, changes):
    assert batch(base(**changes)).request((1, 1, 1), semantics="intended") == set()


@pytest.mark.parametrize(
    "birthdate, as_of, fits",
    [
        (dt.date(2008, 5, 13), dt.datetime(2024, 5, 13), True),  # sixteen just now
        (dt.date(2008, 5, 14), dt.datetime(2024, 5, 13, 23, 59), False),
        (dt.date(2008, 2, 29), dt.datetime(2024, 2, 29), True),
        (dt.date(2007, 2, 28), dt.datetime(2023, 2, 28), True),
        (dt.date(1995, 2, 28), dt.datetime(2011, 2, 27, 23, 0), False),
    ],
)
def test_age_bound(batch, birthdate, as_of, fits):
    b = batch(base(patients=[dict(id=1, id_gender=1, birthdate=birthdate)]), as_of)
    assert b.request((1, 1, 1)) == ({1} if fits else set())


def test_month_end_birthday(batch):
    """Three years after 28 February 2021 is 29 February 2024, so the child is still two."""
    young = base(
        patients=[dict(id=1, id_gender=1, birthdate=dt.date(2021, 2, 28))],
        specialities=[dict(id=1, id_age_group=2)],
    )
    assert batch(young, dt.datetime(2024, 2, 28, 12)).request((1, 1, 1)) == {1}
    assert batch(young, dt.datetime(2024, 2, 29)).request((1, 1, 1)) == set()


def test_journal_reset_as_written(batch):
    """Any acceptance revives all bookings and adds none; later calls see that."""
    journal = [
        dict(id_patient=1, id_ticket=1, status=1),
        dict(id_patient=2, id_ticket=2, status=1),
        dict(id_patient=3, id_ticket=3, status=0),
    ]
    b = batch(base(patient_journals=journal))
    calls = b.calls((1, 1, 1), (2, 2, 2), (3, 4, 4))
    literal = booking.booking_decisions(b.clinic, calls, AS_OF)
    assert accepted(literal) == {1, 3}
    after = booking.journal_after_booking(b.clinic, literal)
    assert sorted(rows(after, "id_patient", "id_ticket", "status")) == [
        (1, 1, 0),
        (2, 2, 0),
        (3, 3, 0),
    ]
    intended = booking.booking_decisions(b.clinic, calls, AS_OF, semantics="intended")
    assert accepted(intended) == {1, 2, 3}
    after = booking.journal_after_booking(b.clinic, intended, semantics="intended")
    assert sorted(rows(after, "id_patient", "id_ticket", "status")) == [
        (1, 1, 0),
        (2, 2, 0),
        (3, 3, 0),
        (4, 4, 0),
    ]
    tickets = booking.tickets_after_booking(b.clinic, literal)
    assert sorted(rows(tickets, "id", "closed")) == [(1, 1), (2, 0), (3, 0), (4, 1)]


def test_nothing_accepted_changes_nothing(batch):
    b = batch(base(patient_journals=[dict(id_patient=1, id_ticket=1, status=1)]))
    decisions = booking.booking_decisions(b.clinic, b.calls((1, 9, 1)), AS_OF)
    assert rows(booking.journal_after_booking(b.clinic, decisions), "status") == [(1,)]
    nobody = booking.booking_decisions(b.clinic, b.calls().limit(0), AS_OF)
    assert nobody.count() == 0
    assert rows(booking.journal_after_booking(b.clinic, nobody), "status") == [(1,)]


def booked(*pairs, status=0):
    return [dict(id_patient=p, id_ticket=t, status=status) for p, t in pairs]


def test_cancel(batch):
    b = batch(base(patient_journals=booked((1, 1), (2, 1), (3, 2)) + booked((4, 3), status=1)))
    calls = b.calls((1, 1, 1), (2, 1, 1), (3, 4, 3), (4, 3, 2), (5, 5, 4), (6, 2, 1))
    decisions = booking.cancel_decisions(b.clinic, calls, AS_OF)
    assert accepted(decisions) == {1, 4, 6}
    journal = booking.journal_after_cancel(b.clinic, decisions)
    assert {r[2] for r in rows(journal, "id_patient", "id_ticket", "status")} == {1}
    closed = base(
        patient_journals=booked((1, 1), (2, 1)),
        tickets=[dict(id=1, id_doctor_speciality=1, closed=1, time_begin=LATER)],
    )
    b = batch(closed)
    decisions = booking.cancel_decisions(b.clinic, b.calls((1, 1, 1)), AS_OF)
    assert rows(booking.tickets_after_cancel(b.clinic, decisions), "closed") == [(0,)]


@pytest.mark.parametrize(
    "as_of, end, ok",
    [
        (dt.datetime(2024, 5, 13, 14, 30), "16:31", True),
        (dt.datetime(2024, 5, 13, 14, 30), "16:30", False),
        (dt.datetime(2024, 5, 14, 10, 0), "18:00", False),  # no hours on a Tuesday
        (dt.datetime(2024, 5, 13, 22, 30), "16:00", True),  # two hours later is 00:30
        (dt.datetime(2024, 5, 20, 10, 0), "18:00", False),  # the ticket begins now
    ],
)
def test_cancel_needs_two_open_hours(batch, as_of, end, ok):
    hours = [dict(id=1, id_week_day=1, id_hospital=1, end_time=end)]
    b = batch(base(patient_journals=booked((1, 1)), hospital_work_times=hours), as_of)
    assert b.cancel((7, 1, 1)) == ({7} if ok else set())


def test_log_request_cancel_request(batch, spark):
    b = batch()
    log = spark.createDataFrame(
        [
            (1, "request", 1, 1),
            (2, "request", 2, 1),
            (3, "cancel", 2, 1),
            (4, "cancel", 1, 1),
            (5, "request", 2, 1),
            (6, "request", 1, 1),
            (7, "request", 3, 2),
        ],
        LOG,
    )
    decisions = booking.booking_log(b.clinic, log, AS_OF)
    assert accepted(decisions) == {1, 4, 5, 7}
    journal = booking.journal_after_log(b.clinic, decisions)
    assert sorted(rows(journal, "id_patient", "id_ticket", "status")) == [
        (1, 1, 1),
        (2, 1, 0),
        (3, 2, 0),
    ]
    tickets = booking.tickets_after_log(b.clinic, decisions)
    assert sorted(rows(tickets, "id", "closed")) == [(1, 1), (2, 1), (3, 0), (4, 0)]


def random_tables(rnd, patients=12, tickets=10):
    def deleted():
        return GONE if rnd.random() < 0.15 else None

    links = [
        dict(id=i, id_speciality=rnd.randint(1, 4), id_doctor=rnd.randint(1, 4))
        for i in range(1, 7)
    ]
    journal = {
        (rnd.randint(1, patients), rnd.randint(1, tickets)): rnd.randint(0, 1)
        for _ in range(tickets)
    }
    return dict(
        hospitals=[dict(id=i, deleted_at=deleted()) for i in (1, 2)],
        doctors=[dict(id=i, id_hospital=i % 2 + 1, deleted_at=deleted()) for i in range(1, 5)],
        specialities=[
            dict(id=i, id_age_group=rnd.choice([3, 4, 4, 4]), deleted_at=deleted())
            for i in range(1, 5)
        ],
        doctor_specialty=links,
        speciality_gender=[
            dict(id_speciality=s, id_gender=g)
            for s in range(1, 5)
            for g in (1, 2)
            if rnd.random() < 0.8
        ],
        hospital_work_times=[
            dict(id=1, id_week_day=1, id_hospital=1, end_time="18:00"),
            dict(id=2, id_week_day=1, id_hospital=2, end_time=rnd.choice(["16:00", "19:00"])),
        ],
        patients=[
            dict(
                id=i,
                id_gender=rnd.randint(1, 2),
                birthdate=dt.date(rnd.choice([1980, 1990, 2012]), 6, 1),
            )
            for i in range(1, patients + 1)
        ],
        patient_documents=[
            dict(id=i, id_patient=rnd.randint(1, patients), id_document_type=rnd.choice([4, 4, 1]))
            for i in range(1, patients * 2)
        ],
        tickets=[
            dict(
                id=i,
                id_doctor_speciality=rnd.randint(1, 6),
                closed=int(rnd.random() < 0.3),
                time_begin=LATER if rnd.random() < 0.85 else AS_OF,
            )
            for i in range(1, tickets + 1)
        ],
        patient_journals=[
            dict(id_patient=p, id_ticket=t, status=s) for (p, t), s in journal.items()
        ],
    )


def compare(b, decisions, model, wanted, journal, tickets):
    assert accepted(decisions) == wanted
    after = rows(journal, "id_patient", "id_ticket", "status")
    assert {(p, t): s for p, t, s in after} == model.journal
    assert len(after) == len(model.journal)
    assert dict(rows(tickets, "id", "closed")) == model.closed()


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("semantics", booking_semantics())
def test_random_requests(batch, seed, semantics):
    rnd = random.Random(seed)
    b = batch(random_tables(rnd))
    calls = [(i * 3, rnd.randint(1, 13), rnd.randint(1, 11)) for i in range(80)]
    model = World(b.tables, AGE_GROUPS, AS_OF)
    wanted = model.run([(s, "request", p, t) for s, p, t in calls], semantics)
    decisions = booking.booking_decisions(b.clinic, b.calls(*calls), AS_OF, semantics=semantics)
    compare(
        b,
        decisions,
        model,
        wanted,
        booking.journal_after_booking(b.clinic, decisions, semantics=semantics),
        booking.tickets_after_booking(b.clinic, decisions),
    )


@pytest.mark.parametrize("seed", range(2))
def test_random_cancels(batch, seed):
    rnd = random.Random(seed)
    b = batch(random_tables(rnd, tickets=25))
    pairs = [(r["id_patient"], r["id_ticket"]) for r in b.tables["patient_journals"]]
    calls = [(i, *rnd.choice(pairs)) for i in range(60)]
    model = World(b.tables, AGE_GROUPS, AS_OF)
    wanted = model.run([(s, "cancel", p, t) for s, p, t in calls])
    assert wanted
    decisions = booking.cancel_decisions(b.clinic, b.calls(*calls), AS_OF)
    compare(
        b,
        decisions,
        model,
        wanted,
        booking.journal_after_cancel(b.clinic, decisions),
        booking.tickets_after_cancel(b.clinic, decisions),
    )


def random_log(rnd, n, patients=13, tickets=11, hot=None):
    calls = []
    for i in range(n):
        op = rnd.choice(["request", "request", "cancel"])
        patient, ticket = rnd.randint(1, patients), rnd.randint(1, tickets)
        if hot and i % 3 == 0:
            ticket = hot
        calls.append((i, op, patient, ticket))
    return calls


@pytest.mark.parametrize("semantics", booking_semantics())
@pytest.mark.parametrize(
    "seed, hot, reach", [(0, None, None), (3, 1, 16)]
)
def test_random_log(batch, spark, monkeypatch, seed, hot, reach, semantics):
    """`reach`: call numbers of a range, so that one ticket's calls lie in many of them."""
    if reach:
        monkeypatch.setattr(asof, "ID_RANGE", reach)
        monkeypatch.setattr(ranking, "ID_RANGE", reach)
    rnd = random.Random(seed)
    b = batch(random_tables(rnd))
    calls = random_log(rnd, 300, hot=hot)
    model = World(b.tables, AGE_GROUPS, AS_OF)
    wanted = model.run(calls, semantics)
    log = spark.createDataFrame(calls, LOG)
    decisions = booking.booking_log(b.clinic, log, AS_OF, semantics=semantics)
    assert decisions.columns == [*LOG.names, "accepted"]
    compare(
        b,
        decisions,
        model,
        wanted,
        booking.journal_after_log(b.clinic, decisions, semantics=semantics),
        booking.tickets_after_log(b.clinic, decisions),
    )


def test_literal_log_revives_cancelled_pairs(batch, spark):
    """An acceptance anywhere makes a cancelled pair active, so it can be cancelled again but
    not asked for."""
    b = batch(base(patient_journals=booked((1, 1), (2, 1))))
    calls = [
        (1, "cancel", 1, 1),
        (2, "cancel", 1, 1),  # cancelled already
        (3, "request", 3, 2),  # accepted: pair (1, 1) is active again
        (4, "request", 1, 1),  # refused for that
        (5, "cancel", 1, 1),
        (6, "request", 1, 1),  # open and cancelled: accepted, and active
        (7, "cancel", 3, 2),  # no row was added, so there is none to cancel
        (8, "cancel", 1, 1),
    ]
    decisions = booking.booking_log(
        b.clinic, spark.createDataFrame(calls, LOG), AS_OF, semantics="literal"
    )
    assert accepted(decisions) == {1, 3, 5, 6, 8}
    journal = booking.journal_after_log(b.clinic, decisions, semantics="literal")
    assert sorted(rows(journal, "id_patient", "id_ticket", "status")) == [(1, 1, 1), (2, 1, 0)]
    with pytest.raises(ValueError):
        booking.booking_log(b.clinic, decisions, AS_OF, semantics="other")


@pytest.mark.parametrize("semantics", booking_semantics())
def test_long_chain_on_one_ticket(batch, spark, monkeypatch, semantics):
    """A ticket that goes from hand to hand very often, in many ranges of calls."""
    monkeypatch.setattr(asof, "ID_RANGE", 20)
    monkeypatch.setattr(ranking, "ID_RANGE", 20)
    b = batch(base(patient_journals=booked((1, 1), (2, 1))))
    calls = []
    for i in range(100):
        patient = 1 + i % 2
        calls += [(2 * i, "request", patient, 1), (2 * i + 1, "cancel", patient, 1)]
    model = World(b.tables, AGE_GROUPS, AS_OF)
    wanted = model.run(calls, semantics)
    log = spark.createDataFrame(calls, LOG)
    assert accepted(booking.booking_log(b.clinic, log, AS_OF, semantics=semantics)) == wanted
    assert len(wanted) > 40


def test_one_ticket_and_one_patient_hold_a_third_each(batch, monkeypatch):
    """Hot keys take the salted joins and the results stay whole."""
    rnd = random.Random(5)
    b = batch(random_tables(rnd, patients=60, tickets=60))
    calls = []
    for i in range(900):
        patient, ticket = rnd.randint(1, 60), rnd.randint(1, 60)
        calls.append((i, 7 if i % 3 == 0 else patient, 3 if i % 3 == 1 else ticket))
    monkeypatch.setattr(skew, "SHARE", 0.2)
    monkeypatch.setattr(skew, "LEAST_ROWS", 100)
    hot_tickets, hot_patients = skew.hot_keys(b.calls(*calls), ["id_ticket"], ["id_patient"])
    assert len(hot_tickets) == 1 and len(hot_patients) == 1
    for semantics in booking_semantics():
        model = World(b.tables, AGE_GROUPS, AS_OF)
        wanted = model.run([(s, "request", p, t) for s, p, t in calls], semantics)
        assert b.request(*calls, semantics=semantics) == wanted


def test_store_batch(batch, tmp_path):
    b = batch(base(patient_journals=booked((5, 4), status=1)))
    calls = b.calls((1, 1, 1), (2, 2, 1), (3, 3, 2))
    decisions = booking.booking_decisions(b.clinic, calls, AS_OF, semantics="intended")
    root = str(tmp_path / "batch")
    new = booking.store_batch(b.clinic, decisions, root, kind="booking", semantics="intended")
    assert sorted(rows(new.tickets, "id", "closed")) == [(1, 1), (2, 1), (3, 0), (4, 0)]
    assert sorted(rows(new.patient_journals, "id_patient", "id_ticket", "status")) == [
        (1, 1, 0),
        (3, 2, 0),
        (5, 4, 1),
    ]
    # The stored state takes the next batch.
    again = booking.cancel_decisions(new, b.calls((1, 1, 1), (2, 5, 4)), AS_OF)
    assert accepted(again) == {1}
    later = booking.store_batch(new, again, str(tmp_path / "later"), kind="cancel")
    assert dict(rows(later.tickets, "id", "closed"))[1] == 0
    with pytest.raises(ValueError):
        booking.store_batch(new, again, str(tmp_path / "other"), kind="other")
