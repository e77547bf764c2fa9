"""The twenty domain tables: columns, keys, links, defaults and value limits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

LONG = T.LongType()
INT = T.IntegerType()
TEXT = T.StringType()
STAMP = T.TimestampNTZType()


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    key: tuple[str, ...] = ("id",)
    unique: tuple[tuple[str, ...], ...] = ()
    links: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    digits: dict[str, int] = field(default_factory=dict)
    lengths: dict[str, int] = field(default_factory=dict)

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema if not f.nullable]

    @property
    def constraints(self) -> list[tuple[str, ...]]:
        return [self.key, *self.unique]


def _table(name, required, optional=(), *, order=None, short=None, **rest) -> Table:
    """`required` and `optional` are (column, type) pairs; `order` restores a mixed order."""
    fields = {c: T.StructField(c, t, False) for c, t in required}
    fields |= {c: T.StructField(c, t, True) for c, t in optional}
    columns = order.split() if order else list(fields)
    lengths = {c: 255 for c in columns if fields[c].dataType == TEXT} | (short or {})
    return Table(name, T.StructType([fields[c] for c in columns]), lengths=lengths, **rest)


_ALL = [
    _table(
        "users",
        [("id", LONG), ("name", TEXT), ("email", TEXT), ("password", TEXT)],
        unique=(("email",),),
    ),
    _table("genders", [("id", LONG), ("name", TEXT)]),
    _table(
        "patients",
        [
            ("id", LONG),
            ("id_user", LONG),
            ("first_name", TEXT),
            ("last_name", TEXT),
            ("birthdate", T.DateType()),
            ("id_gender", LONG),
            ("area", TEXT),
        ],
        [("patronymic", TEXT), ("phone", LONG)],
        order="id id_user first_name last_name patronymic birthdate id_gender phone area",
        links={"id_user": "users", "id_gender": "genders"},
    ),
    _table(
        "document_types", [("id", LONG), ("type_name", TEXT)], unique=(("type_name",),)
    ),
    _table(
        "patient_documents",
        [
            ("id", LONG),
            ("name", TEXT),
            ("id_patient", LONG),
            ("file_name", TEXT),
            ("id_document_type", LONG),
        ],
        [("content", T.BinaryType())],
        order="id name id_patient file_name content id_document_type",
        links={"id_patient": "patients", "id_document_type": "document_types"},
    ),
    _table(
        "regions",
        [("id", LONG), ("name", TEXT), ("code", INT)],
        unique=(("name", "code"),),
        digits={"code": 3},
    ),
    _table(
        "towns",
        [("id", LONG), ("name", TEXT), ("id_region", LONG)],
        unique=(("name",),),
        links={"id_region": "regions"},
    ),
    _table(
        "organizations",
        [("id", LONG), ("name", TEXT), ("id_town", LONG)],
        links={"id_town": "towns"},
    ),
    _table("hospital_types", [("id", LONG), ("name", TEXT)]),
    _table("week_days", [("id", INT)], [("name", TEXT)], digits={"id": 1}),
    _table(
        "hospitals",
        [
            ("id", LONG),
            ("name", TEXT),
            ("id_organization", LONG),
            ("status", INT),
            ("id_type", LONG),
        ],
        [("deleted_at", STAMP)],
        order="id deleted_at name id_organization status id_type",
        links={"id_organization": "organizations", "id_type": "hospital_types"},
        defaults={"status": 0},
    ),
    _table(
        "hospital_work_times",
        [("id", LONG)],
        [
            ("id_week_day", INT),
            ("id_hospital", LONG),
            ("begin_time", TEXT),
            ("end_time", TEXT),
        ],
        unique=(("id_week_day", "id_hospital"),),
        links={"id_week_day": "week_days", "id_hospital": "hospitals"},
        digits={"id_week_day": 1},
        short={"begin_time": 5, "end_time": 5},
    ),
    _table(
        "doctors",
        [
            ("id", LONG),
            ("area", TEXT),
            ("degree", INT),
            ("qualification", TEXT),
            ("salary", T.DecimalType(18, 2)),
            ("id_hospital", LONG),
        ],
        [("deleted_at", STAMP)],
        order="id deleted_at area degree qualification salary id_hospital",
        links={"id_hospital": "hospitals"},
    ),
    _table(
        "doctors_reviews",
        [("id", LONG), ("id_doctor", LONG), ("review", TEXT), ("rate", INT)],
        links={"id_doctor": "doctors"},
        defaults={"rate": 0},
        digits={"rate": 1},
        short={"review": 4000},
    ),
    _table(
        "age_groups",
        [("id", LONG), ("age_begin", INT), ("age_end", INT)],
        [("name", TEXT)],
        order="id name age_begin age_end",
        defaults={"age_begin": 0, "age_end": 999},
        digits={"age_begin": 3, "age_end": 3},
    ),
    _table(
        "specialities",
        [("id", LONG), ("id_age_group", LONG)],
        [("deleted_at", STAMP)],
        order="id deleted_at id_age_group",
        links={"id_age_group": "age_groups"},
    ),
    _table(
        "doctor_specialty",
        [("id", LONG), ("id_speciality", LONG), ("id_doctor", LONG)],
        links={"id_speciality": "specialities", "id_doctor": "doctors"},
    ),
    _table(
        "speciality_gender",
        [("id_speciality", LONG), ("id_gender", LONG)],
        key=("id_speciality", "id_gender"),
        links={"id_speciality": "specialities", "id_gender": "genders"},
    ),
    _table(
        "tickets",
        [
            ("id", LONG),
            ("id_doctor_speciality", LONG),
            ("closed", INT),
            ("time_begin", STAMP),
            ("time_end", STAMP),
        ],
        links={"id_doctor_speciality": "doctor_specialty"},
        defaults={"closed": 0},
        digits={"closed": 1},
    ),
    _table(
        "patient_journals",
        [("id_patient", LONG), ("id_ticket", LONG), ("status", INT)],
        key=("id_patient", "id_ticket"),
        links={"id_patient": "patients", "id_ticket": "tickets"},
        defaults={"status": 0},
    ),
]

TABLES: dict[str, Table] = {t.name: t for t in _ALL}

# Inputs of the batch writes; `seq` is unique and gives the order of the calls.
REQUESTS = T.StructType(
    [T.StructField(c, LONG, False) for c in ("seq", "id_patient", "id_ticket")]
)
LOG = T.StructType(
    [
        T.StructField("seq", LONG, False),
        T.StructField("op", TEXT, False),
        T.StructField("id_patient", LONG, False),
        T.StructField("id_ticket", LONG, False),
    ]
)
