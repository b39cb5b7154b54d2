"""Very many rules on every event: equal terms are looked at once, and only rules of which a term holds are judged."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cache, reduce
from operator import and_, or_
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import Field
from ..functions.predicates import RuleError, _number, _text, modifier
from .rules import Rule, condition

#: Values of a field whose terms are remembered.
REMEMBERED = 100_000


class Term:
    """A condition over numbered atoms, built by the same operators as a Column."""

    __slots__ = ("kind", "parts", "least")

    def __init__(self, kind: str, parts: Any = (), least: int = 0):
        self.kind, self.parts, self.least = kind, parts, least

    def __or__(self, other: Term) -> Term:
        return Term("or", (self, other))

    def __and__(self, other: Term) -> Term:
        return Term("and", (self, other))

    def __invert__(self) -> Term:
        return Term("not", (self,))

    def cast(self, _: str) -> Term:
        return Term("sum", (self,))

    def __add__(self, other: Term) -> Term:
        return Term("sum", self.parts + other.parts)

    def __ge__(self, least: int) -> Term:
        return Term("count", self.parts, least)

    def holds(self, rows: Callable[[int], np.ndarray], n: int) -> np.ndarray:
        """Of n rows, those where it holds; ``rows`` tells that of an atom."""
        if self.kind == "atom":
            return rows(self.parts)
        if self.kind in ("true", "false"):
            return np.full(n, self.kind == "true")
        own = [p.holds(rows, n) for p in self.parts]
        if self.kind == "count":
            return np.sum(own, axis=0, dtype=np.int64) >= self.least
        return ~own[0] if self.kind == "not" else reduce(and_ if self.kind == "and" else or_, own)

    def needs(self) -> frozenset[int] | None:
        """Atoms of which one holds wherever this does; none if there is no such set. Of an AND the smallest set of a part will do."""
        if self.kind == "atom":
            return frozenset([self.parts])
        if self.kind == "false":
            return frozenset()
        if self.kind in ("or", "count", "and"):
            own = [p.needs() for p in self.parts]
            if self.kind == "and":
                return min((o for o in own if o is not None), key=len, default=None)
            if self.kind == "count" and self.least < 1:
                return None
            return None if None in own else frozenset().union(*own)
        return None


TRUE, FALSE = Term("true"), Term("false")


class Index:
    """The terms of many rules, by field and by how they compare; equal terms are one atom."""

    def __init__(self):
        self.atoms: dict[tuple, int] = {}
        self.fields: list[str] = []

    def atom(self, name: str, how: str, value: Any) -> Term:
        if name not in self.fields:
            self.fields.append(name)
        # True and 1 are equal in Python, but not in a rule
        return Term("atom", self.atoms.setdefault((name, how, type(value).__name__, value), len(self.atoms)))

    def matches(self, key: str, want: Any, known: Callable[[str], bool]) -> Term:
        name, how = modifier(key)
        if how == "exists":
            wanted = want if isinstance(want, bool) else _text(want).lower() == "true"
            return self.atom(name, how, wanted) if known(name) else FALSE if wanted else TRUE
        values = want if isinstance(want, list) else [want]
        if not values or not known(name):
            return FALSE
        return reduce(or_, [self.atom(name, "" if how == "in" else how, v if v is None or isinstance(v, (bool, int, float, str)) else _text(v)) for v in values])

    def selection(self, spec: Any, known: Callable[[str], bool]) -> Term:
        if isinstance(spec, list):
            return reduce(or_, [self.selection(s, known) for s in spec], FALSE)
        if not isinstance(spec, dict):
            raise RuleError(f"a selection is a map or a list of maps, not {type(spec).__name__}")
        for key in spec:
            modifier(key)
        return reduce(and_, [self.matches(k, v, known) for k, v in spec.items()], TRUE)

    def rule(self, rule: Rule, known: Callable[[str], bool]) -> Term:
        if not isinstance(rule.detection, dict) or not rule.detection:
            raise RuleError("detection has no selection")
        return condition(rule.condition, {name: self.selection(spec, known) for name, spec in rule.detection.items()})


class Terms:
    """The atoms of one field; tells which hold for a value."""

    def __init__(self, atoms: Iterable[tuple[str, str, Any, int]], numeric: bool):
        """atoms: (how, type, value, number); numeric: is the column one of numbers?"""
        self.numeric = numeric
        self.equal, self.numbers, self.other = defaultdict(list), defaultdict(list), defaultdict(list)
        self.truth, self.exists, self.always = defaultdict(list), defaultdict(list), []
        self.words, self.bounds, self.patterns = defaultdict(list), defaultdict(list), []
        for how, kind, value, number in atoms:
            low = _text(value).lower()
            if how == "exists":
                self.exists[value].append(number)
            elif how == "re":
                self.patterns.append(number)
            elif how in ("contains", "startswith", "endswith"):
                (self.words[low] if low else self.always).append((how, number) if low else number)
            elif how in ("gt", "gte", "lt", "lte"):
                bound = _number(value)
                if bound is not None and bound == bound:
                    self.bounds[how].append((bound, number))
            elif kind == "bool":
                self.truth[value].append(number)
            elif (as_number := _number(value)) is None:
                self.equal[low].append(number)
            else:
                # how a value that spells a number compares depends on what it meets
                if as_number == as_number:
                    self.numbers[as_number].append(number)
                self.other[low].append((number, kind == "str", "false" if value in (0, "0") else "true"))
        self.loose = [(n, text, truth, low) for low, own in self.other.items() for n, text, truth in own]
        self.bounds = {how: (np.array([b for b, _ in sorted(own)]), [n for _, n in sorted(own)]) for how, own in self.bounds.items()}
        self.automaton = None
        if self.words:
            self.automaton = ahocorasick.Automaton()
            for word, own in self.words.items():
                self.automaton.add_word(word, (len(word), own))
            self.automaton.make_automaton()

    def of(self, present: bool, low: str, number: float | None, is_bool: bool) -> list[int]:
        """The atoms that hold, but for patterns."""
        out = list(self.exists[present])
        if not present:
            return out
        out += self.equal.get(low, ())
        truth = low == "true" if is_bool else (number != 0 if number is not None else low != "") if self.numeric else low != ""
        out += self.truth.get(truth, ())
        if is_bool:
            out += [n for n, text, want, own in self.loose if (low == own if text else low == want)]
        elif number is not None:
            out += self.numbers.get(number, ()) if number == number else ()
        else:
            out += [n for n, *_ in self.other.get(low, ())]
        if number is not None and number == number:
            for how, (bounds, numbers) in self.bounds.items():
                if how in ("gt", "gte"):
                    out += numbers[: int(np.searchsorted(bounds, number, "left" if how == "gt" else "right"))]
                else:
                    out += numbers[int(np.searchsorted(bounds, number, "right" if how == "lt" else "left")) :]
        out += self.always
        if self.automaton is not None and low:
            n, seen = len(low), set()
            for end, (size, own) in self.automaton.iter(low):
                for how, atom in own:
                    if atom not in seen and (how == "contains" or how == "startswith" and end + 1 == size or how == "endswith" and end + 1 == n):
                        seen.add(atom)
                        out.append(atom)
        return out


def indexed_hits(base: DataFrame, rules: Iterable[Rule], fields: Callable[[str], Field | None], keep: list[str]) -> tuple[DataFrame | None, list[Rule], list[tuple[str, str]]]:
    """(hits, rules, errors): the columns ``keep`` of each row of ``base`` and ``rule``, the place in ``rules`` of one that matches it.

    Fields are read by Spark, once each, and so are distinct patterns. For each batch the distinct values of a field give
    the atoms that hold: by a map for equal text and numbers, by an automaton for parts of text, by bisection for bounds.
    A rule is judged only if one of the atoms that it needs holds somewhere in the batch, over all rows of the batch at
    once. No shuffle; works on streams.
    """
    fields = cache(fields)  # a look-up builds Columns
    index, terms, good, bad = Index(), [], [], []
    known = lambda name: fields(name) is not None
    for r in rules:
        try:
            terms.append(index.rule(r, known))
            good.append(r)
        except RuleError as e:
            bad.append((r.rule_id, str(e)))
    if not good:
        return None, good, bad
    own = [(name, fields(name)) for name in index.fields]
    by_field = {name: [] for name in index.fields}
    for (name, how, kind, value), number in index.atoms.items():
        by_field[name].append((how, kind, value, number))
    tables = [Terms(by_field[name], field.kind == "number") for name, field in own]
    patterns = [(name, value, number) for (name, how, _, value), number in index.atoms.items() if how == "re"]
    found = dict(own)
    values = [F.struct(f.present.alias("present"), F.lower(f.text).alias("low"), f.number.alias("number"), f.is_bool.alias("bool")).alias(f"_f{i}") for i, (_, f) in enumerate(own)]
    matched = [F.array(*[found[n].present & found[n].text.rlike("(?iU)" + _text(v)) for n, v, _ in patterns[i : i + 100]]).alias(f"_p{i // 100}") for i in range(0, len(patterns), 100)]
    needs: dict[int, list[int]] = defaultdict(list)
    every = []
    for k, t in enumerate(terms):
        need = t.needs()
        if need is None:
            every.append(k)
        for a in need or ():
            needs[a].append(k)
    rows = base.select(*keep, *values, *matched)
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("rule", T.IntegerType(), False)])

    def holding(b: pa.RecordBatch, remembered: list[dict]) -> dict[int, np.ndarray]:
        """Rows where each atom holds, of those that hold somewhere."""
        n, out = b.num_rows, {}
        for i, table in enumerate(tables):
            column = b.column(f"_f{i}")
            present, low, number, is_bool = (column.field(k) for k in ("present", "low", "number", "bool"))
            codes = pc.fill_null(low, "").dictionary_encode()
            key = codes.indices.to_numpy().astype(np.int64) * 4 + pc.fill_null(present, False).to_numpy(zero_copy_only=False) * 2 + pc.fill_null(is_bool, False).to_numpy(zero_copy_only=False)
            distinct, first, group = np.unique(key, return_index=True, return_inverse=True)
            words, memory = codes.dictionary, remembered[i]
            holders = defaultdict(list)
            for g, (k, at) in enumerate(zip(distinct.tolist(), first.tolist(), strict=True)):
                name = (words[k // 4].as_py(), k % 4)
                if (atoms := memory.get(name)) is None:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    atoms = memory[name] = table.of(bool(k & 2), name[0], number[at].as_py(), bool(k & 1))
                for a in atoms:
                    holders[a].append(g)
            order = np.argsort(group, kind="stable")
            starts = np.append(np.searchsorted(group[order], np.arange(len(distinct))), n)
            for a, groups in holders.items():
                mask = np.zeros(n, bool)
                for g in groups:
                    mask[order[starts[g] : starts[g + 1]]] = True
                out[a] = mask
        for i in range(0, len(patterns), 100):
            column = b.column(f"_p{i // 100}")
            flat = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            out.update((patterns[i + j][2], flat[:, j].astype(bool)) for j in np.flatnonzero(flat.any(0)).tolist())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: list[dict] = [{} for _ in tables]
        for b in batches:
            if not (n := b.num_rows):
                continue
            masks, none = holding(b, remembered), np.zeros(n, bool)
            at, which = [], []
            for k in sorted({*every, *(k for a in masks for k in needs.get(a, ()))}):
                hits = np.flatnonzero(terms[k].holds(lambda a: masks.get(a, none), n))
                at.append(hits)
                which.append(np.full(len(hits), k, np.int32))
            at, which = np.concatenate([[], *at]).astype(np.int64), np.concatenate([[], *which]).astype(np.int32)
            for s in range(0, len(at), 1 << 16):
                rows_ = b.select(keep).take(pa.array(at[s : s + (1 << 16)]))
                yield pa.RecordBatch.from_arrays([*rows_.columns, pa.array(which[s : s + (1 << 16)])], names=[*keep, "rule"])

    return rows.mapInArrow(run, schema), good, bad
