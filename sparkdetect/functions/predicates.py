"""The modifiers of a rule's fields as Columns that are never null."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import Field


class RuleError(ValueError):
    """A rule that cannot be compiled."""


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _number(value: Any) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def exact(field: Field, want: Any) -> Column:
    """Booleans first, so that True is not 1; then numbers; then text without case."""
    text = F.lower(field.text) == _text(want).lower()
    if isinstance(want, bool):
        truth = F.when(field.is_bool, F.lower(field.text) == "true").otherwise(F.coalesce(field.number != 0, field.text != "") if field.kind == "number" else field.text != "")
        return truth == want
    number = _number(want)
    if number is None:
        return text
    same = field.number == F.lit(number) if number == number else F.lit(False)
    numeric = F.coalesce(same & ~F.isnan(field.number), F.lit(False))
    other = F.lower(field.text) == "true" if want not in (0, "0") else F.lower(field.text) == "false"
    loose = text if isinstance(want, str) else other
    return F.when(field.is_bool, loose).when(field.number.isNotNull(), numeric).otherwise(text)


def _compare(op: Callable[[Column, Column], Column]) -> Callable[[Field, Any], Column]:
    def compare(field: Field, want: Any) -> Column:
        number = _number(want)
        if number is None or number != number:
            return F.lit(False)
        # Spark puts NaN above all numbers; no comparison with it holds here
        return F.coalesce(op(field.number, F.lit(number)) & ~F.isnan(field.number), F.lit(False))

    return compare


MODIFIERS: dict[str, Callable[[Field, Any], Column]] = {
    "": exact,
    "contains": lambda f, v: F.lower(f.text).contains(_text(v).lower()),
    "startswith": lambda f, v: F.lower(f.text).startswith(_text(v).lower()),
    "endswith": lambda f, v: F.lower(f.text).endswith(_text(v).lower()),
    "re": lambda f, v: f.text.rlike("(?iU)" + _text(v)),
    "gt": _compare(lambda a, b: a > b),
    "gte": _compare(lambda a, b: a >= b),
    "lt": _compare(lambda a, b: a < b),
    "lte": _compare(lambda a, b: a <= b),
    "in": exact,
}


def modifier(key: str) -> tuple[str, str]:
    name, _, how = key.partition("|")
    how = how.strip().lower()
    if how != "exists" and how not in MODIFIERS:
        raise RuleError(f"unsupported modifier '|{how}' on field '{name}'")
    return name, how


def matches(key: str, want: Any, fields: Callable[[str], Field | None]) -> Column:
    """One field: a list of values is an OR; a missing field matches only ``exists: false``."""
    name, how = modifier(key)
    field = fields(name)
    if how == "exists":
        wanted = want if isinstance(want, bool) else _text(want).lower() == "true"
        present = field.present if field else F.lit(False)
        return present == wanted
    if field is None:
        return F.lit(False)
    values = want if isinstance(want, list) else [want]
    if not values:
        return F.lit(False)
    if how == "in" and field.kind == "text" and all(isinstance(v, str) and _number(v) is None for v in values):
        any_of = F.lower(field.text).isin([v.lower() for v in values])
    else:
        any_of = reduce(Column.__or__, [MODIFIERS[how](field, v) for v in values])
    return field.present & any_of


def selection(spec: Any, fields: Callable[[str], Field | None]) -> Column:
    """A map is an AND of its fields, a list of maps an OR of them."""
    if isinstance(spec, list):
        return reduce(Column.__or__, [selection(s, fields) for s in spec], F.lit(False))
    if not isinstance(spec, dict):
        raise RuleError(f"a selection is a map or a list of maps, not {type(spec).__name__}")
    for key in spec:
        modifier(key)
    return reduce(Column.__and__, [matches(k, v, fields) for k, v in spec.items()], F.lit(True))
