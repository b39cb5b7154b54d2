"""How rules bear rewritten text: rows that a rule matched are rewritten without changing what they mean, and matched again."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import Field
from .rules import Rule, compile_all
from .scorecard import ratio

Rewrite = Callable[[Column, Column], Column]


def draw(key: Column, *parts: Column | int | str, n: Column | int) -> Column:
    """A repeatable whole number from 0 to n - 1."""
    n = n if isinstance(n, Column) else F.lit(n)
    digest = F.md5(F.concat_ws(":", key, *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n).cast("int")


def case_flip(value: Column, key: Column) -> Column:
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(draw(key, "case", i.cast("string"), n=2) == 0, F.upper(c)).otherwise(F.lower(c))), "")


def _inserted(value: Column, key: Column, what: str, above: int, first: int) -> Column:
    """``what`` inside one token longer than ``above``; white space becomes single spaces, as with all splitting rewrites."""
    parts = F.filter(F.split(value, r"\s+"), lambda p: p != "")
    at = draw(key, what, "token", n=F.greatest(F.size(parts), F.lit(1)))
    cut = lambda p: draw(key, what, "cut", n=F.greatest(F.length(p) - 1 - first, F.lit(1))) + first
    new = F.transform(parts, lambda p, i: F.when((i == at) & (F.length(p) > above), F.concat(F.substring(p, F.lit(1), cut(p)), F.lit(what), F.substring(p, cut(p) + 1, F.length(p)))).otherwise(p))
    return F.when(F.size(parts) == 0, value).otherwise(F.array_join(new, " "))


def quote_insertion(value: Column, key: Column) -> Column:
    return _inserted(value, key, '""', 4, 2)


def caret_escape(value: Column, key: Column) -> Column:
    return _inserted(value, key, "^", 3, 1)


# Long flags and their short forms, tools and other names.
FLAGS = (
    ("-EncodedCommand", "-ec"), ("-encodedcommand", "-ec"), ("-NoProfile", "-nop"), ("-noprofile", "-nop"), ("-WindowStyle Hidden", "-w hid"), ("-windowstyle hidden", "-w hid"), ("-NonInteractive", "-noni"), ("-ExecutionPolicy Bypass", "-ep bypass"),
)
RENAMES = (
    ("powershell.exe", "svc_update.exe"), ("vssadmin.exe", "vs_helper.exe"), ("PsExec64.exe", "remote_admin.exe"), ("psexec.exe", "remote_admin.exe"), ("7z.exe", "archiver.exe"), ("net.exe", "netutil.exe"), ("nltest.exe", "dctest.exe"),
)


def flag_abbreviation(value: Column, key: Column) -> Column:
    for long, short in FLAGS:
        value = F.replace(value, F.lit(long), F.lit(short))
    return value


def path_padding(value: Column, key: Column) -> Column:
    """The first drive's Windows folder by a detour; only the first, as the lazy part in front is anchored."""
    return F.regexp_replace(value, r"^((?s).*?)([A-Za-z]:\\)(Windows\\)", r"$1$2Windows\\System32\\..\\")


def binary_rename(value: Column, key: Column) -> Column:
    """The first listed tool that is named gets another name."""
    out = F.when(F.lit(False), value)
    for old, new in RENAMES:
        out = out.when(F.lower(value).contains(old.lower()), F.regexp_replace(value, r"(?i)" + old.replace(".", r"\."), new))
    return out.otherwise(value)


def whitespace_padding(value: Column, key: Column) -> Column:
    """The first two spaces become two to four."""
    parts = F.split(value, " ", 3)
    pads = [F.repeat(F.lit(" "), draw(key, "pad", k, n=3) + 2) for k in (0, 1)]
    return F.when(F.size(parts) == 1, value).when(F.size(parts) == 2, F.concat(parts[0], pads[0], parts[1])).otherwise(F.concat(parts[0], pads[0], F.get(parts, 1), pads[1], F.get(parts, 2)))


MUTATIONS: dict[str, Rewrite] = {
    "case_flip": case_flip, "quote_insertion": quote_insertion, "flag_abbreviation": flag_abbreviation, "path_padding": path_padding, "caret_escape": caret_escape, "binary_rename": binary_rename, "whitespace_padding": whitespace_padding,
}
#: What these rewrite names another tool; a rule for one tool may miss them by design.
IDENTITY = ("binary_rename",)


def _in_map(fields: str, keys: tuple[str, ...], rewrite: Rewrite, key: Callable[[str], Column]) -> Column:
    """The map with the texts under ``keys`` rewritten."""
    new = {name: rewrite(F.try_variant_get(F.try_element_at(fields, F.lit(name)), "$", "string"), key(name)).cast("variant") for name in keys}

    def value(k: Column, v: Column) -> Column:
        out = v
        for name, column in new.items():
            out = F.when((k == name) & (F.schema_of_variant(v) == "STRING"), column).otherwise(out)
        return out

    return F.transform_values(fields, value)


def evaluate(
    events: DataFrame, rules: Iterable[Rule], columns: tuple[str, ...], fields: Callable[[str], Field | None], mutations: Iterable[str] | None = None, seed: int = 0, rewrites: dict[str, Rewrite] = MUTATIONS, within: str | None = None
) -> DataFrame:
    """(rule_id, rule_title, event_id, technique_id, mutation, detected_mutated) for malicious events that a rule matched.

    ``columns`` are the text columns that are rewritten, or with ``within`` the keys of that map of variants whose
    texts are; all else stays. Choices follow from the event's id, so
    results do not depend on order. Only matched rows are multiplied by the mutations; conditions are evaluated in the same pass.
    """
    names = list(mutations if mutations is not None else rewrites)
    if unknown := [n for n in names if n not in rewrites]:
        raise ValueError(f"unknown mutations: {unknown}")
    good, _ = compile_all(list(rules), fields)
    first = events.where("technique_id IS NOT NULL").withColumn("_hit", F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, (_, c) in enumerate(good)]))).where(F.size("_hit") > 0)
    variants = []
    for n in names:
        key = lambda c, n=n: F.concat_ws(":", F.lit(str(seed)), F.col("event_id").cast("string"), F.lit(c), F.lit(n))
        variants.append(F.struct(F.lit(n).alias("mutation"), *([_in_map(within, columns, rewrites[n], key).alias(within)] if within else [rewrites[n](F.col(c), key(c)).alias(c) for c in columns])))
    spread = first.withColumn("_m", F.explode(F.array(*variants)))
    rewritten = spread.withColumns({"mutation": F.col("_m.mutation"), **{c: F.col(f"_m.{c}") for c in ((within,) if within else columns)}})
    again = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, (_, c) in enumerate(good)]))
    head = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.title).alias("rule_title")) for r, _ in good])
    out = rewritten.withColumn("_again", again).withColumn("_i", F.explode("_hit"))
    return out.select(F.get(head, F.col("_i")).alias("h"), F.col("event_id").cast("string").alias("event_id"), "technique_id", "mutation", F.array_contains("_again", F.col("_i")).alias("detected_mutated")).select("h.*", "event_id", "technique_id", "mutation", "detected_mutated")


def by_rule(results: DataFrame) -> DataFrame:
    """For each rule, over mutations that keep the tool's name: tested, evaded, survival, fragile, the mutations that defeat it, and renames that do."""
    same = ~F.col("mutation").isin(list(IDENTITY))
    lost = ~F.col("detected_mutated")
    out = results.groupBy("rule_id", "rule_title").agg(
        F.count_if(same).alias("tested"), F.count_if(same & lost).alias("evaded"), F.array_sort(F.collect_set(F.when(same & lost, F.col("mutation")))).alias("defeated_by"), F.count_if(~same & lost).alias("renames_evaded")
    )
    return out.withColumns({"survival": F.when(F.col("tested") == 0, 1.0).otherwise(1 - ratio(F.col("evaded"), F.col("tested"))), "fragile": F.col("evaded") > 0})


def by_mutation(results: DataFrame) -> DataFrame:
    """For each mutation: tested, evaded, and distinct rules that it defeats."""
    lost = ~F.col("detected_mutated")
    return results.groupBy("mutation").agg(F.count("*").alias("tested"), F.count_if(lost).alias("evaded"), F.countDistinct(F.when(lost, F.col("rule_id"))).alias("rules_defeated"))


def score(results: DataFrame) -> DataFrame:
    """One row: cases over mutations that keep the tool's name, evasions, and 1 - evasions / cases (1 for none)."""
    same = ~F.col("mutation").isin(list(IDENTITY))
    out = results.agg(F.count_if(same).alias("cases"), F.count_if(same & ~F.col("detected_mutated")).alias("evasions"))
    return out.withColumn("score", F.when(F.col("cases") == 0, 1.0).otherwise(1 - ratio(F.col("evasions"), F.col("cases"))))
