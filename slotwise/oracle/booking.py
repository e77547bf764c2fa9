"""Checks for bookings: the whole join per call, and call-by-call recursion for the log."""

from __future__ import annotations

from slotwise.oracle.reads import NOON
from slotwise.oracle.tables import with_tables
from slotwise.queries import SPOILT_CALLS

LIMIT = "16:30"  # two hours after the moment of the batch, a Monday

# Tickets first, as few are ahead; policies as counts, and the gender as a condition on pairs
# that have met, so no step is larger than calls or tickets.
_MATCHES = f"""
    SELECT r.seq, r.id_patient, r.id_ticket, t.closed, CAST(sum(pd.policies) AS BIGINT) AS n
    FROM {{calls}} r
    JOIN (SELECT t.id, t.closed, s.id AS id_speciality, ag.age_begin, ag.age_end
          FROM tickets t
          JOIN doctor_specialty ds ON ds.id = t.id_doctor_speciality
          JOIN specialities s ON s.id = ds.id_speciality AND s.deleted_at IS NULL
          JOIN doctors d ON d.id = ds.id_doctor AND d.deleted_at IS NULL
          JOIN hospitals h ON h.id = d.id_hospital AND h.deleted_at IS NULL
          JOIN age_groups ag ON ag.id = s.id_age_group
          WHERE t.time_begin > {NOON} {{extra}}) t ON t.id = r.id_ticket
    JOIN patients p ON p.id = r.id_patient
    JOIN (SELECT id_patient, count(*) AS policies FROM patient_documents
          WHERE id_document_type = 4 GROUP BY id_patient) pd ON pd.id_patient = p.id
    WHERE (t.id_speciality, p.id_gender) IN (SELECT id_speciality, id_gender FROM speciality_gender)
      AND p.birthdate + to_months(t.age_begin * 12) <= {NOON}
      AND p.birthdate + to_months(t.age_end * 12) > {NOON}
    GROUP BY ALL"""

_OPEN_MATCHES = _MATCHES.format(calls="requests", extra="AND t.closed = 0")

_BOOKED = "SELECT id_patient, id_ticket FROM patient_journals WHERE status = 0"

_CANCELLABLE = f"""
    SELECT t.id AS id_ticket, t.closed
    FROM tickets t
    JOIN doctor_specialty ds ON ds.id = t.id_doctor_speciality
    JOIN specialities s ON s.id = ds.id_speciality
    JOIN doctors d ON d.id = ds.id_doctor
    JOIN hospital_work_times w ON w.id_hospital = d.id_hospital
    WHERE t.time_begin > {NOON} AND w.id_week_day = 1 AND w.end_time > '{LIMIT}'
    GROUP BY t.id, t.closed HAVING count(*) = 1"""


def _booking_steps(semantics: str) -> dict[str, str]:
    steps = {"matches": _OPEN_MATCHES}
    if semantics == "intended":
        steps["able"] = f"""
            SELECT seq, id_patient, id_ticket FROM matches m WHERE n >= 1
            AND NOT EXISTS (SELECT 1 FROM ({_BOOKED}) j
                            WHERE j.id_patient = m.id_patient AND j.id_ticket = m.id_ticket)"""
        steps["candidates"] = "SELECT * FROM able"
    else:
        steps["able"] = """
            SELECT m.seq, m.id_patient, m.id_ticket, j.status
            FROM matches m LEFT JOIN patient_journals j USING (id_patient, id_ticket)
            WHERE n = 1 AND (j.status IS NULL OR j.status <> 0)"""
        steps["candidates"] = """
            SELECT * FROM able
            WHERE status IS NULL OR seq <= (SELECT min(seq) FROM able)"""
    steps["winners"] = """
        SELECT seq, id_patient, id_ticket FROM candidates
        QUALIFY row_number() OVER (PARTITION BY id_ticket ORDER BY seq) = 1"""
    return steps


_CANCEL_STEPS = {
    "cancellable": _CANCELLABLE,
    "winners": f"""
        SELECT c.seq, c.id_patient, c.id_ticket
        FROM cancels c
        JOIN ({_BOOKED}) j USING (id_patient, id_ticket)
        JOIN cancellable USING (id_ticket)
        QUALIFY row_number() OVER (PARTITION BY c.id_patient, c.id_ticket ORDER BY c.seq) = 1""",
}

_UPSERT = """
    SELECT coalesce(j.id_patient, w.id_patient) AS id_patient,
           coalesce(j.id_ticket, w.id_ticket) AS id_ticket,
           CAST(CASE WHEN w.seq IS NULL THEN j.status ELSE {status} END AS INTEGER) AS status
    FROM patient_journals j FULL JOIN winners w
      ON w.id_patient = j.id_patient AND w.id_ticket = j.id_ticket"""

_TICKETS = """
    SELECT t.id, t.id_doctor_speciality,
           CAST(CASE WHEN t.id IN (SELECT id_ticket FROM winners) THEN {closed}
                     ELSE t.closed END AS INTEGER) AS closed,
           t.time_begin, t.time_end
    FROM tickets t"""

# The log is folded call by call: `k` numbers the calls of a ticket.
_LOG_STEPS = {
    "fitting": "SELECT seq, id_patient, id_ticket, closed, op FROM ("
    + _MATCHES.format(
        calls="(SELECT * FROM booking_log WHERE op = 'request')", extra=""
    ).replace("SELECT r.seq,", "SELECT r.op, r.seq,", 1)
    + ")",
    "cancellable": _CANCELLABLE,
    "calls": """
        SELECT *, row_number() OVER (PARTITION BY id_ticket ORDER BY seq) AS k FROM (
            SELECT seq, id_patient, id_ticket, closed, op FROM fitting
            UNION ALL
            SELECT c.seq, c.id_patient, c.id_ticket, x.closed, c.op
            FROM booking_log c JOIN cancellable x USING (id_ticket)
            WHERE c.op = 'cancel')""",
    "held": f"SELECT id_ticket, list(id_patient) AS who FROM ({_BOOKED}) GROUP BY id_ticket",
    "fold": """
        SELECT c.id_ticket, 0::BIGINT AS k, c.closed = 1 AS shut,
               coalesce(h.who, []::BIGINT[]) AS who, NULL::BIGINT AS seq, FALSE AS accepted
        FROM calls c LEFT JOIN held h USING (id_ticket) WHERE c.k = 1
        UNION ALL
        SELECT id_ticket, k, CASE WHEN ok THEN op = 'request' ELSE shut END,
               CASE WHEN NOT ok THEN who
                    WHEN op = 'request' THEN list_append(who, id_patient)
                    ELSE list_filter(who, lambda x: x <> id_patient) END,
               seq, ok
        FROM (SELECT c.id_ticket, c.k, f.shut, f.who, c.seq, c.op, c.id_patient,
                     CASE WHEN c.op = 'request'
                          THEN NOT f.shut AND NOT list_contains(f.who, c.id_patient)
                          ELSE list_contains(f.who, c.id_patient) END AS ok
              FROM fold f JOIN calls c ON c.id_ticket = f.id_ticket AND c.k = f.k + 1)""",
    "winners": "SELECT seq FROM fold WHERE accepted",
}


# As written, an acceptance makes all rows active. Given the acceptances of one step, the next
# follows call by call from windows and as-of joins; the last two steps have to agree.
_LITERAL_STEPS = 5


def _literal_log_steps() -> dict[str, str]:
    fitting = _MATCHES.format(calls="(SELECT * FROM booking_log WHERE op = 'request')", extra="")
    steps = {
        "fitting": f"SELECT * FROM ({fitting}) WHERE n = 1",
        "cancellable": _CANCELLABLE,
        "calls": """
            SELECT *, max(seq) FILTER (op = 'cancel') OVER (
                       PARTITION BY id_patient, id_ticket ORDER BY seq
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended
            FROM (SELECT f.seq, 'request' AS op, id_patient, id_ticket, closed, j.status
                  FROM fitting f LEFT JOIN patient_journals j USING (id_patient, id_ticket)
                  UNION ALL
                  SELECT c.seq, c.op, id_patient, id_ticket, closed, j.status
                  FROM booking_log c JOIN cancellable USING (id_ticket)
                  JOIN patient_journals j USING (id_patient, id_ticket)
                  WHERE c.op = 'cancel')""",
        "won_0": "SELECT seq FROM calls WHERE op = 'request'",
    }
    for k in range(1, _LITERAL_STEPS + 1):
        steps[f"state_{k}"] = f"""
            SELECT c.*, CASE WHEN status IS NULL THEN op = 'request'
                             WHEN ended IS NULL THEN (status = 0 OR g.seq IS NOT NULL) = (op = 'cancel')
                             ELSE coalesce(g.seq > ended, FALSE) = (op = 'cancel') END AS useful
            FROM calls c ASOF LEFT JOIN won_{k - 1} g ON c.seq > g.seq"""
        steps[f"open_{k}"] = f"""
            SELECT *, last_value(CASE WHEN useful THEN op END IGNORE NULLS) OVER (
                          PARTITION BY id_ticket ORDER BY seq
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
            FROM state_{k}"""
        steps[f"won_{k}"] = f"""
            SELECT seq FROM open_{k} WHERE useful AND op = 'request'
            AND CASE WHEN before IS NULL THEN closed = 0 ELSE before = 'cancel' END"""
    last = _LITERAL_STEPS
    steps["settled"] = f"""
        SELECT CASE WHEN EXISTS (SELECT seq FROM won_{last} EXCEPT SELECT seq FROM won_{last - 1})
                      OR EXISTS (SELECT seq FROM won_{last - 1} EXCEPT SELECT seq FROM won_{last})
               THEN error('not settled') ELSE 1 END AS one"""
    steps["winners"] = f"""
        SELECT seq FROM (SELECT seq FROM won_{last}
                         UNION ALL SELECT seq FROM state_{last} WHERE useful AND op = 'cancel')
        WHERE (SELECT one FROM settled) = 1"""
    return steps


def _decisions(calls: str, columns: str = "") -> str:
    return f"""
    SELECT c.seq, c.id_patient, c.id_ticket, {columns} w.seq IS NOT NULL AS accepted
    FROM {calls} c LEFT JOIN winners w ON w.seq = c.seq"""


_LAST = """
    SELECT * FROM (SELECT c.* FROM booking_log c JOIN winners USING (seq))
    QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY seq DESC) = 1"""


_FAULTS = """
    SELECT 'seq is missing' AS fault, count(*) AS n_rows FROM {log} WHERE seq IS NULL
    UNION ALL SELECT 'seq is repeated', count(seq) - count(DISTINCT seq) FROM {log}
    UNION ALL SELECT 'id_patient is no whole number', count(*) FROM {log}
              WHERE NOT regexp_full_match(trim(id_patient::VARCHAR), '-?[0-9]+([.]0*)?')
    UNION ALL SELECT 'id_ticket is no whole number', count(*) FROM {log}
              WHERE NOT regexp_full_match(trim(id_ticket::VARCHAR), '-?[0-9]+([.]0*)?')
    UNION ALL SELECT 'op is unknown', count(*) FROM {log}
              WHERE op IS NULL OR op NOT IN ('request', 'cancel')"""


def statements() -> dict[str, str]:
    found = {
        "booking_eligibility": with_tables(
            f"""
            SELECT r.seq, r.id_patient, r.id_ticket, coalesce(m.n, 0) AS match_count,
                   j.id_ticket IS NOT NULL AS already_booked
            FROM requests r LEFT JOIN matches m ON m.seq = r.seq
            LEFT JOIN ({_BOOKED}) j ON j.id_patient = r.id_patient AND j.id_ticket = r.id_ticket""",
            matches=_OPEN_MATCHES,
        ),
        "cancel_decisions": with_tables(_decisions("cancels"), **_CANCEL_STEPS),
        "journal_after_cancel": with_tables(_UPSERT.format(status=1), **_CANCEL_STEPS),
        "tickets_after_cancel": with_tables(_TICKETS.format(closed=0), **_CANCEL_STEPS),
        "booking_log": with_tables(
            _decisions("booking_log", "c.op,"), recursive=True, **_LOG_STEPS
        ),
        "journal_after_log": with_tables(
            _UPSERT.format(status="(w.op = 'cancel')::INT").replace("winners w", "last w"),
            recursive=True,
            **_LOG_STEPS,
            last=_LAST.format(keys="id_patient, id_ticket"),
        ),
        "tickets_after_log": with_tables(
            """
            SELECT t.id, t.id_doctor_speciality,
                   coalesce((w.op = 'request')::INTEGER, t.closed) AS closed,
                   t.time_begin, t.time_end
            FROM tickets t LEFT JOIN last w ON w.id_ticket = t.id""",
            recursive=True,
            **_LOG_STEPS,
            last=_LAST.format(keys="id_ticket"),
        ),
    }
    literal, last = _literal_log_steps(), _LAST.format(keys="id_ticket")
    found |= {
        "booking_log_literal": with_tables(_decisions("booking_log", "c.op,"), **literal),
        "journal_after_log_literal": with_tables(
            """
            SELECT id_patient, id_ticket,
                   CAST(CASE WHEN e.ended > coalesce(r.reset, -1) THEN 1
                             WHEN r.reset IS NOT NULL THEN 0 ELSE j.status END AS INTEGER) AS status
            FROM patient_journals j
            LEFT JOIN (SELECT id_patient, id_ticket, max(seq) AS ended FROM booking_log
                       JOIN winners USING (seq) WHERE op = 'cancel' GROUP BY ALL) e
                USING (id_patient, id_ticket)
            CROSS JOIN (SELECT max(seq) AS reset FROM booking_log
                        JOIN winners USING (seq) WHERE op = 'request') r""",
            **literal,
        ),
        "tickets_after_log_literal": with_tables(
            """
            SELECT t.id, t.id_doctor_speciality,
                   coalesce((w.op = 'request')::INTEGER, t.closed) AS closed,
                   t.time_begin, t.time_end
            FROM tickets t LEFT JOIN last w ON w.id_ticket = t.id""",
            **literal,
            last=last,
        ),
    }
    for semantics in ("literal", "intended"):
        steps = _booking_steps(semantics)
        journal = _UPSERT.format(status=0)
        if semantics == "literal":
            journal = """
                SELECT id_patient, id_ticket,
                       CAST(CASE WHEN EXISTS (SELECT 1 FROM winners) THEN 0
                                 ELSE status END AS INTEGER) AS status
                FROM patient_journals"""
        found |= {
            f"booking_decisions_{semantics}": with_tables(_decisions("requests"), **steps),
            f"journal_after_booking_{semantics}": with_tables(journal, **steps),
            f"tickets_after_booking_{semantics}": with_tables(
                _TICKETS.format(closed=1), **steps
            ),
        }
    found["booking_decisions_from_text"] = found["booking_decisions_literal"]
    found["cancel_decisions_from_int"] = found["cancel_decisions"]
    for name, log in {"call_faults": "booking_log", "call_faults_spoiled": "spoilt"}.items():
        values = [f"{v} AS {k}" for k, v in SPOILT_CALLS.items()]
        steps = {"spoilt": f"SELECT {', '.join(values)} FROM booking_log"} if log == "spoilt" else {}
        found[name] = with_tables(_FAULTS.format(log=log), **steps)
    return found
