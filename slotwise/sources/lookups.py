"""Small lookup tables with fixed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotwise.sources.schemas import TABLES

# Ids, names and age bounds must equal the reference data for right results.
GENDERS = [
    (1, "мужской"),
    (2, "женский"),
    (3, "девочка-мальчик"),
    (4, "мальчик-девочка"),
]
AGE_GROUPS = [
    (1, "Младенчество", 0, 1),
    (2, "Ранний возраст", 1, 3),
    (3, "Школьный возраст", 7, 18),
    (4, "Совершеннолетний", 16, 999),
    (5, "Пожилой", 61, 75),
]
WEEK_DAYS = [
    (1, "понедельник"),
    (2, "вторник"),
    (3, "среда"),
    (4, "четверг"),
    (5, "пятница"),
    (6, "суббота"),
    (7, "воскресенье"),
]
HOSPITAL_TYPES = [(1, "частная"), (2, "государственная")]
DOCUMENT_TYPES = [(1, "Пасспорт"), (2, "ИНН"), (3, "СНИЛС")]
# The health policy that a booking needs; the check uses code 4.
HEALTH_POLICY = (4, "ОМС")

LOOKUPS = {
    "genders": ("id name", GENDERS),
    "age_groups": ("id name age_begin age_end", AGE_GROUPS),
    "week_days": ("id name", WEEK_DAYS),
    "hospital_types": ("id name", HOSPITAL_TYPES),
    "document_types": ("id type_name", [*DOCUMENT_TYPES, HEALTH_POLICY]),
}


def values_sql(name: str) -> str:
    """The rows as a VALUES clause; both Spark SQL and DuckDB read it."""
    columns, rows = LOOKUPS[name]
    body = ", ".join(
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")"
        for row in rows
    )
    return f"SELECT * FROM (VALUES {body}) AS v({', '.join(columns.split())})"


def lookup(spark: SparkSession, name: str) -> DataFrame:
    """A local relation, so its few rows are known to the optimizer."""
    schema = TABLES[name].schema
    casts = [f"CAST({f.name} AS {f.dataType.simpleString()}) {f.name}" for f in schema]
    return spark.sql(values_sql(name)).selectExpr(*casts)
