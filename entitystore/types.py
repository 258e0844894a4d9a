"""Type codes, typed column names, and inference."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

#: Type code to Spark type.
CODES = {"I": "int", "L": "bigint", "DT": "bigint", "F": "float", "D": "double", "S": "string", "B": "boolean"}


class EntityIdTypeError(TypeError):
    """Ids of one shard are all strings or all integers."""


@dataclass(frozen=True)
class ColumnId:
    """A column's name and type code; stored as name_code, split at the last underscore."""

    name: str
    code: str

    def __post_init__(self):
        if self.code not in CODES:
            raise ValueError(f"unknown type code {self.code!r}")

    @classmethod
    def parse(cls, full: str) -> ColumnId:
        name, _, code = full.rpartition("_")
        if not name:
            raise ValueError(f"no type code in {full!r}")
        return cls(name, code)

    def __str__(self) -> str:
        return f"{self.name}_{self.code}"


def infer(value: object) -> str:
    """The type code of a sample value."""
    for kind, code in ((bool, "B"), (int, "L"), (float, "D"), (str, "S"), ((dt.datetime, dt.date), "DT")):
        if isinstance(value, kind):
            return "I" if code == "L" and -(2**31) <= value < 2**31 else code
    raise TypeError(f"no type code for {type(value).__name__}")


def code_of(kind: str) -> str:
    """The type code of a Spark type's name; types without one of their own are texts."""
    if kind.startswith("timestamp") or kind == "date":
        return "DT"
    return {t: c for c, t in CODES.items() if c != "DT"}.get(kind, "S")
