"""How a rule's field name finds its value: typed columns of a flat table, or a map of variants."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = ("event_id", "source", "event_type", "host", "user")


@dataclass(frozen=True)
class Field:
    """A value, whether it is there at all, and its kind: bool, number, text or variant."""

    value: Column
    present: Column
    kind: str

    @property
    def text(self) -> Column:
        """The value as text; a null that is present is empty."""
        value = F.try_variant_get(self.value, "$", "string") if self.kind == "variant" else self.value.cast("string")
        return F.coalesce(value, F.lit(""))

    @property
    def number(self) -> Column:
        """The value as a number, null where it is none."""
        return self.value.cast("double") if self.kind in ("number", "bool") else number(self.text)

    @property
    def known(self) -> Column:
        """Is it there, and not null?"""
        some = ~F.coalesce(F.is_variant_null(self.value), F.lit(True)) if self.kind == "variant" else self.value.isNotNull()
        return self.present & some

    @property
    def is_bool(self) -> Column:
        if self.kind == "variant":
            return F.coalesce(F.schema_of_variant(self.value) == "BOOLEAN", F.lit(False))
        return F.lit(self.kind == "bool")


def number(text: Column) -> Column:
    """Text that spells a number; try_cast alone would take ``1d`` too."""
    plain = text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$") | text.rlike(r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$")
    return F.when(plain, F.trim(text).try_cast("double"))


class FlatFields:
    """Fields of a table with typed columns. A name is a column, an alias, or the last dotted part of a column; the last such column wins."""

    def __init__(self, schema: T.StructType | DataFrame, aliases: Mapping[str, str | Column] | None = None):
        self.schema = schema.schema if isinstance(schema, DataFrame) else schema
        self.aliases = dict(aliases or {})

    def __call__(self, name: str) -> Field | None:
        kinds = {f.name: f.dataType for f in self.schema.fields}
        to = self.aliases.get(name, name)
        if isinstance(to, Column):
            return Field(to, to.isNotNull(), "text")
        if to not in kinds:
            tails = [n for n in kinds if n.rpartition(".")[2] == to]
            if not tails:
                return None
            to = tails[-1]
        kind = "bool" if isinstance(kinds[to], T.BooleanType) else "number" if isinstance(kinds[to], T.NumericType) else "variant" if isinstance(kinds[to], T.VariantType) else "text"
        value = F.col(f"`{to}`")
        return Field(value, value.isNotNull(), kind)


class MapFields:
    """Fields in a column of type MAP<STRING, VARIANT>, behind the envelope's columns.

    A dotted name is a key. A bare name is the last key with that last part, else the envelope's column; so a
    field ``x.user`` stands before the envelope's ``user``.
    """

    def __init__(self, fields: str = "fields", envelope: tuple[str, ...] = ENVELOPE):
        self.fields, self.envelope = fields, envelope

    def __call__(self, name: str) -> Field:
        entries = F.map_entries(self.fields)
        same = (lambda e: e["key"] == name) if "." in name else (lambda e: F.substring_index(e["key"], ".", -1) == name)
        found = F.filter(entries, same)
        value = F.try_element_at(found, F.lit(-1))["value"]
        present = F.coalesce(F.size(found) > 0, F.lit(False))
        if name in self.envelope:
            own = F.to_variant_object(F.array(F.col(name)))
            value = F.when(present, value).otherwise(F.try_variant_get(own, "$[0]", "variant"))
            present = present | F.col(name).isNotNull()
        return Field(value, present, "variant")
