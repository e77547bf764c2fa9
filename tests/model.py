"""Plain Python reading of the booking rules, one call after the other."""

from __future__ import annotations

import calendar
import datetime as dt


def month_shift(day: dt.date, months: int) -> dt.date:
    """Month ends stay month ends."""
    total = day.year * 12 + day.month - 1 + months
    year, month = divmod(total, 12)
    last = calendar.monthrange(year, month + 1)[1]
    at_end = day.day == calendar.monthrange(day.year, day.month)[1]
    return dt.date(year, month + 1, last if at_end else min(day.day, last))


class World:
    """Tables as lists of dicts; `journal` maps (patient, ticket) to a status."""

    def __init__(self, tables: dict[str, list[dict]], ages: list[tuple], as_of: dt.datetime):
        self.t = {name: [dict(r) for r in rows] for name, rows in tables.items()}
        self.as_of = as_of
        self.ages = {a[0]: (a[2], a[3]) for a in ages}
        self.tickets = {r["id"]: r for r in self.t["tickets"]}
        self.journal = {
            (r["id_patient"], r["id_ticket"]): r["status"] for r in self.t["patient_journals"]
        }

    def _by_id(self, table):
        return {r["id"]: r for r in self.t[table]}

    def matches(self, patient: int, ticket: int) -> int:
        """Rows of the full join for one call."""
        t, p = self.tickets.get(ticket), self._by_id("patients").get(patient)
        if t is None or p is None or t["closed"] or not t["time_begin"] > self.as_of:
            return 0
        link = self._by_id("doctor_specialty").get(t["id_doctor_speciality"])
        if link is None:
            return 0
        s = self._by_id("specialities").get(link["id_speciality"])
        d = self._by_id("doctors").get(link["id_doctor"])
        h = d and self._by_id("hospitals").get(d["id_hospital"])
        if not (s and d and h) or any(x.get("deleted_at") for x in (s, d, h)):
            return 0
        low, high = self.ages[s["id_age_group"]]
        midnight = dt.time()
        reached = dt.datetime.combine(month_shift(p["birthdate"], low * 12), midnight)
        passed = dt.datetime.combine(month_shift(p["birthdate"], high * 12), midnight)
        if not reached <= self.as_of < passed:
            return 0
        genders = sum(
            g["id_speciality"] == s["id"] and g["id_gender"] == p["id_gender"]
            for g in self.t["speciality_gender"]
        )
        policies = sum(
            r["id_patient"] == patient and r["id_document_type"] == 4
            for r in self.t["patient_documents"]
        )
        return genders * policies

    def request(self, patient: int, ticket: int, semantics: str) -> bool:
        pair = (patient, ticket)
        if self.journal.get(pair) == 0:
            return False
        n = self.matches(patient, ticket)
        if not (n == 1 if semantics == "literal" else n >= 1):
            return False
        if semantics == "literal":
            self.journal = dict.fromkeys(self.journal, 0)
        else:
            self.journal[pair] = 0
        self.tickets[ticket]["closed"] = 1
        return True

    def cancel(self, patient: int, ticket: int) -> bool:
        if self.journal.get((patient, ticket)) != 0:
            return False
        t = self.tickets.get(ticket)
        if t is None or not t["time_begin"] > self.as_of:
            return False
        link = self._by_id("doctor_specialty").get(t["id_doctor_speciality"])
        d = link and self._by_id("doctors").get(link["id_doctor"])
        limit = (self.as_of + dt.timedelta(hours=2)).strftime("%H:%M")
        found = d and sum(
            w["id_hospital"] == d["id_hospital"]
            and w["id_week_day"] == self.as_of.isoweekday()
            and w["end_time"] > limit
            for w in self.t["hospital_work_times"]
        )
        if found != 1:
            return False
        self.journal[(patient, ticket)] = 1
        t["closed"] = 0
        return True

    def run(self, calls: list[tuple], semantics: str = "intended") -> set[int]:
        """Accepted `seq` of calls (seq, op, patient, ticket)."""
        accepted = set()
        for seq, op, patient, ticket in sorted(calls):
            ok = (
                self.request(patient, ticket, semantics)
                if op == "request"
                else self.cancel(patient, ticket)
            )
            if ok:
                accepted.add(seq)
        return accepted

    def closed(self) -> dict[int, int]:
        return {i: t["closed"] for i, t in self.tickets.items()}
