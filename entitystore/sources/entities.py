"""Entities built value by value, and the rows they stand for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..types import CODES, ColumnId, EntityIdTypeError


@dataclass
class Entity:
    """An id, a version, and rows of values of some columns."""

    id: int | str
    version: int
    columns: list[ColumnId]
    rows: list[tuple] = field(default_factory=list)

    @classmethod
    def of(cls, id: int | str, version: int, columns: list[ColumnId], values: list) -> Entity:
        """An entity from its values, row after row; they must fill whole rows."""
        n = len(columns)
        if len(values) % n if n else values:
            raise ValueError(f"{len(values)} values make no rows of {n}")
        return cls(id, version, columns, [tuple(values[i : i + n]) for i in range(0, len(values), n)])

    def add(self, *values: object) -> Entity:
        if len(values) != len(self.columns):
            raise ValueError(f"a row has {len(self.columns)} values, not {len(values)}")
        self.rows.append(values)
        return self

    def value(self, row: int, column: int) -> object:
        """A value by the numbers, from 1, of its row and column."""
        if row < 1 or column < 1:
            raise IndexError("rows and columns count from 1")
        return self.rows[row - 1][column - 1]

    def column(self, name: str) -> list:
        """A column's values, row after row; an entity without rows has one null."""
        i = [c.name for c in self.columns].index(name)
        return [r[i] for r in self.rows] or [None]


def frames(spark: SparkSession, entities: list[Entity], key: str = "entity_id", version: str = "_version") -> tuple[DataFrame, DataFrame]:
    """Rows of entities of the same columns, and key and version of those that have none: what EntityTable.write takes."""
    kinds = {type(e.id) for e in entities}
    if len(kinds) > 1 or not kinds <= {int, str}:
        raise EntityIdTypeError("entity ids are all strings or all integers")
    if len({tuple(e.columns) for e in entities}) > 1:
        raise ValueError("entities of one call have the same columns")
    head = f"{key} {'string' if kinds == {str} else 'bigint'}, {version} bigint"
    columns = entities[0].columns if entities else []
    rows = [(e.id, e.version, *r) for e in entities for r in e.rows]
    return spark.createDataFrame(rows, ", ".join([head, *(f"{c.name} {CODES[c.code]}" for c in columns)])), spark.createDataFrame([(e.id, e.version) for e in entities if not e.rows], head)
