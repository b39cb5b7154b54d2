"""Rules as data: specs, compilation to Columns, validation, fingerprints, dimension tables."""

from __future__ import annotations

import hashlib
import json
import operator
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cache, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import Field
from ..functions.predicates import RuleError, selection

#: Severities from the least.
SEVERITIES = ("info", "low", "medium", "high", "critical")
KINDS = ("sequence", "threshold", "distinct")


def severity_rank(severity: Column) -> Column:
    return reduce(lambda c, s: c.when(severity == s, SEVERITIES.index(s)), SEVERITIES[1:], F.when(severity == SEVERITIES[0], 0)).cast("int")


@dataclass(frozen=True)
class Rule:
    """A rule over single events."""

    rule_id: str
    detection: dict[str, Any]
    condition: str
    title: str = ""
    severity: str = "medium"
    techniques: tuple[str, ...] = ()
    tactic: str = ""
    enabled: bool = True
    source: str = "handwritten"
    description: str = ""
    false_positives: tuple[str, ...] = ()
    references: tuple[str, ...] = ()
    technique_names: tuple[str, ...] = ()

    @property
    def fingerprint(self) -> str:
        """The same for rules of the same logic, whatever their names."""
        return hashlib.sha256(json.dumps([self.detection, self.condition], sort_keys=True, default=str).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Correlation:
    """A rule over events in time order that share a field: a sequence of stages, a count, or a count of distinct values."""

    rule_id: str
    kind: str
    window: int
    group_by: str = "host"
    stages: tuple[dict[str, Any], ...] = ()
    excludes: tuple[dict[str, Any] | None, ...] = ()
    select: dict[str, Any] | None = None
    threshold: int = 1
    distinct_field: str | None = None
    title: str = ""
    severity: str = "medium"
    techniques: tuple[str, ...] = ()
    tactic: str = ""
    enabled: bool = True
    description: str = ""
    false_positives: tuple[str, ...] = ()
    references: tuple[str, ...] = ()
    technique_names: tuple[str, ...] = ()

    def check(self) -> None:
        if self.kind not in KINDS:
            raise RuleError(f"{self.rule_id}: kind must be one of {KINDS}")
        if self.window <= 0:
            raise RuleError(f"{self.rule_id}: window must be positive")
        if self.kind == "sequence":
            if len(self.stages) < 2:
                raise RuleError(f"{self.rule_id}: a sequence needs two stages or more")
        elif not self.select or self.threshold < 2:
            raise RuleError(f"{self.rule_id}: {self.kind} needs a selection and a threshold of two or more")
        if self.kind == "distinct" and not self.distinct_field:
            raise RuleError(f"{self.rule_id}: distinct needs a field")

    @property
    def fingerprint(self) -> str:
        own = [self.kind, self.window, self.group_by, self.stages, self.excludes, self.select, self.threshold, self.distinct_field]
        return hashlib.sha256(json.dumps(own, sort_keys=True, default=str).encode()).hexdigest()[:16]


_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9_*.]+)")


def condition(text: str, named: dict[str, Any]) -> Any:
    """``text`` over named selections: not before and before or; all/any/N of them, a name or a prefix*.

    Only selection names and the words above may stand there; anything else is an error, and nothing of the text is
    evaluated or passed to SQL. Selections are Columns, or whatever else has their operators.
    """
    tokens, at = [], 0
    while at < len(text or "") and text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise RuleError(f"unexpected character in condition: {text[at:].strip()[0]!r}")
        tokens.append(m[1])
        at = m.end()
    if not tokens:
        raise RuleError("condition is empty")

    def word(*options: str) -> bool:
        return bool(tokens) and tokens[0].lower() in options

    def chain(name: str, join: Callable[[Any, Any], Any], below: Callable[[], Any]) -> Any:
        out = below()
        while word(name):
            tokens.pop(0)
            out = join(out, below())
        return out

    def either() -> Any:
        return chain("or", operator.or_, lambda: chain("and", operator.and_, unit))

    def unit() -> Any:
        if not tokens:
            raise RuleError("condition ended unexpectedly")
        token = tokens.pop(0)
        if token.lower() == "not":
            return ~unit()
        if token == "(":
            out = either()
            if not tokens or tokens.pop(0) != ")":
                raise RuleError("unbalanced parentheses in condition")
            return out
        if (token.lower() in ("all", "any") or token.isdigit()) and word("of"):
            tokens.pop(0)
            return quantified(token.lower(), tokens.pop(0) if tokens else "")
        if token not in named:
            raise RuleError(f"condition names an undefined selection: {token!r}")
        return named[token]

    def quantified(least: str, target: str) -> Any:
        names = list(named) if target.lower() == "them" else [n for n in named if n.startswith(target[:-1])] if target.endswith("*") else [n for n in named if n == target]
        if not names:
            raise RuleError(f"'{least} of {target}' names no selection")
        hits = reduce(operator.add, [named[n].cast("int") for n in names])
        return hits >= (len(names) if least == "all" else 1 if least == "any" else int(least))

    out = either()
    if tokens:
        raise RuleError(f"unexpected {tokens[0]!r} in condition")
    return out


def compiled(rule: Rule, fields: Callable[[str], Field | None]) -> Column:
    """The rule as one boolean Column; raises RuleError."""
    if not isinstance(rule.detection, dict) or not rule.detection:
        raise RuleError("detection has no selection")
    return condition(rule.condition, {name: selection(spec, fields) for name, spec in rule.detection.items()})


def compile_all(rules: Iterable[Rule], fields: Callable[[str], Field | None]) -> tuple[list[tuple[Rule, Column]], list[tuple[str, str]]]:
    """Rules that compile, and (rule_id, error) of the others: a broken rule stops no other."""
    good, bad, fields = [], [], cache(fields)  # a look-up builds Columns
    for r in rules:
        try:
            good.append((r, compiled(r, fields)))
        except RuleError as e:
            bad.append((r.rule_id, str(e)))
    return good, bad


def validate(rules: Iterable[Rule | Correlation], fields: Callable[[str], Field | None]) -> list[tuple[str, str]]:
    """(rule_id, error) of the rules that do not compile; no data needed."""
    out = []
    for r in rules:
        try:
            if isinstance(r, Rule):
                compiled(r, fields)
            else:
                r.check()
                for s in [*r.stages, *filter(None, r.excludes), *([r.select] if r.select else [])]:
                    selection(s, fields)
        except RuleError as e:
            out.append((r.rule_id, str(e)))
    return out


RULES_SCHEMA = "rule_id string, title string, severity string, severity_rank int, techniques array<string>, tactic string, kind string, enabled boolean, fingerprint string, description string, false_positives array<string>, references array<string>, technique_names array<string>"


def rules_table(spark: SparkSession, rules: Iterable[Rule | Correlation]) -> DataFrame:
    """A row for each rule."""
    rows = [(r.rule_id, r.title, r.severity, SEVERITIES.index(r.severity), list(r.techniques), r.tactic, getattr(r, "kind", "single"), r.enabled, r.fingerprint, r.description, list(r.false_positives), list(r.references), list(r.technique_names or r.techniques)) for r in rules]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def errors_table(spark: SparkSession, errors: Iterable[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(errors), "rule_id string, error string")


def rule_listing(rules: DataFrame, errors: DataFrame) -> DataFrame:
    """Each rule with its status: invalid, disabled or ok."""
    bad = errors.groupBy("rule_id").agg(F.min("error").alias("error"))
    status = F.when(F.col("error").isNotNull(), "invalid").when(~F.col("enabled"), "disabled").otherwise("ok")
    return rules.join(F.broadcast(bad), "rule_id", "left").select("rule_id", "title", "severity", "kind", status.alias("status"), F.col("error"), "techniques", "technique_names", "tactic", "description", "false_positives", "references")
