"""Correlation over time: sequences, thresholds and distinct counts within a window and a key."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import groupby
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import Field
from ..functions.predicates import RuleError, selection
from .detect import EVENT, SCOPE, _head, event_struct, scoped, with_alert_id
from .rules import Correlation

#: A key of a rule with more events than this is cut along time, into pieces of about so many events; one of so many keys at most.
HOT_ROWS, PIECE_ROWS, HOT_KEYS = 1 << 20, 1 << 18, 1024


class Seen(NamedTuple):
    """A relevant event: time in microseconds, id, the stages that it matches as bits or the value that is counted, and where it is."""

    t: int
    id: str | None
    mark: Any
    at: Any


class _Queues:
    """The events ahead, and for each later stage a queue of those that match it; taken ones are jumped over."""

    def __init__(self, stages: int):
        self.events: list[Seen] = []
        self.first = 0  # number of the first event held
        self.waiting: list[list[int]] = [[] for _ in range(stages)]
        self.skip: list[list[int]] = [[] for _ in range(stages)]  # where to look on, itself if the event is still there
        self.rows: dict[str | None, list[int]] = {}
        self.gone: set[int] = set()

    def add(self, e: Seen, gone: bool) -> None:
        number = self.first + len(self.events)
        self.events.append(e)
        self.rows.setdefault(e.id, []).append(number)
        if gone:
            self.gone.add(number)
            return
        for k in range(1, len(self.waiting)):
            if e.mark >> k & 1:
                self.skip[k].append(len(self.waiting[k]))
                self.waiting[k].append(number)

    def take(self, name: str | None) -> None:
        """All rows of an id are used up."""
        for number in self.rows.get(name, ()):
            self.gone.add(number)
            for k in range(1, len(self.waiting)):
                if self[number].mark >> k & 1:
                    j = bisect_right(self.waiting[k], number) - 1
                    if j >= 0 and self.waiting[k][j] == number:
                        self.skip[k][j] = j + 1

    def __getitem__(self, number: int) -> Seen:
        return self.events[number - self.first]

    def after(self, stage: int, number: int, taken: set[str | None]) -> int | None:
        """The first event after ``number`` that waits for ``stage`` and has none of the ids in ``taken``."""
        queue, skip = self.waiting[stage], self.skip[stage]
        j = bisect_right(queue, number)
        while True:
            path = []
            while j < len(queue) and skip[j] != j:
                path.append(j)
                j = skip[j]
            for p in path:
                skip[p] = j
            if j >= len(queue):
                return None
            if self[queue[j]].id not in taken:
                return queue[j]
            j += 1

    def forget(self, before: int) -> None:
        """Drop what lies before an event; costs as much as what stays, so it waits until that is less than what goes."""
        n = before - self.first
        if n < 4096 or 2 * n < len(self.events):
            return
        kept, gone, held = self.events[n:], self.gone, self.waiting
        live = [[q for i, (q, s) in enumerate(zip(queue, skip, strict=True)) if q >= before and s == i] for queue, skip in zip(held, self.skip, strict=True)]
        self.events, self.first = kept, before
        self.waiting, self.skip = live, [list(range(len(q))) for q in live]
        self.gone = {g for g in gone if g >= before}
        self.rows = {}
        for i, e in enumerate(kept):
            self.rows.setdefault(e.id, []).append(before + i)


def sequence_chains(events: Iterable[Seen], stages: int, window: int) -> Iterator[list[Seen]]:
    """Chains among ``events``, which come in time order; no more than a window (in microseconds) of them is held.

    From each event of the first stage that is left, the earliest left event of the next stage is taken, up to the
    deadline; only a chain that is complete uses up its events, all rows of their ids. Each step of a chain is a look
    into a queue, so time grows with the events, however many wait in one window.
    """
    source, queues, used, at = iter(events), _Queues(stages), {}, 0
    ended, most = False, 10_000
    while True:
        while at - queues.first >= len(queues.events):
            if (e := next(source, None)) is None:
                return
            queues.add(e, e.id in used)
        first = queues[at]
        if not first.mark & 1 or at in queues.gone:
            at += 1
            queues.forget(at)
            continue
        while not ended and queues.events[-1].t - first.t <= window:
            if (e := next(source, None)) is None:
                ended = True
            else:
                queues.add(e, e.id in used)
        chain, taken = [at], {first.id}
        while len(chain) < stages:
            found = queues.after(len(chain), chain[-1], taken)
            if found is None or queues[found].t - first.t > window:
                break
            chain.append(found)
            taken.add(queues[found].id)
        if len(chain) == stages:
            if len(used) > most:  # rows of one id lie near each other; as many again come before the next look, so that all looks together cost as much as what was added
                used = {i: t for i, t in used.items() if first.t - t <= window}
                most = max(10_000, 2 * len(used))
            used.update((queues[c].id, queues[c].t) for c in chain)
            hit = [queues[c] for c in chain]
            for name in taken:
                queues.take(name)
            yield hit
        at += 1
        queues.forget(at)


def counted_chains(events: Iterable[Seen], rule: Correlation) -> Iterator[list[Seen]]:
    """Hits of a threshold or distinct rule in time order; after a hit the window starts anew. The number of live values is kept, not counted again."""
    live, values, window, distinct, plain = deque(), Counter(), rule.window * 1_000_000, 0, rule.kind == "threshold"
    for e in events:
        while live and e.t - live[0].t > window:
            v = live.popleft().mark
            if not plain and v is not None:
                values[v] -= 1
                if not values[v]:
                    del values[v]
        live.append(e)
        if not plain and e.mark is not None:
            values[e.mark] += 1
        distinct = len(live) if plain else len(values)
        if distinct >= rule.threshold:
            yield list(live)
            live.clear()
            values.clear()


class Piece:
    """Events of one key from ``start`` to ``end``, after those of the window before ``start``, for a threshold or distinct rule.

    An event may end a hit if the window before it holds enough values; ``least`` is the last event at which that hit may
    begin. Where the last hit before ``start`` ended decides which do.
    """

    def __init__(self, times: np.ndarray, marks: list[Any], start: int, end: int, rule: Correlation):
        window, n = rule.window * 1_000_000, len(times)
        self.times, self.before = times, int(np.searchsorted(times, start, "left"))
        self.tail = int(np.searchsorted(times, end - window, "left"))
        self.opens = np.searchsorted(times, times - window, "left")
        least = np.arange(n) - rule.threshold + 1 if rule.kind == "threshold" else self._distinct(marks, rule.threshold)
        ends = np.flatnonzero((self.opens <= least) & (np.arange(n) >= self.before))
        self.ends, self.least = ends, least[ends]
        self.then = np.searchsorted(self.least, ends + 1, "left")  # the next hit after each, the window having started anew

    @staticmethod
    def _distinct(marks: list[Any], threshold: int) -> np.ndarray:
        """For each event the last one from which on it has ``threshold`` values."""
        out, live, low = np.full(len(marks), -1), Counter(), 0
        for i, v in enumerate(marks):
            if v is not None:
                live[v] += 1
            # as long as the first event can go, it goes: what is left has exactly the number
            while len(live) > threshold or len(live) == threshold and (marks[low] is None or live[marks[low]] > 1):
                if marks[low] is not None:
                    live[marks[low]] -= 1
                    if not live[marks[low]]:
                        del live[marks[low]]
                low += 1
            if len(live) == threshold:
                out[i] = low
        return out

    def from_here(self, after: int) -> int:
        """Number in ``ends`` of the first hit, if a hit ended at event ``after`` (-1: none)."""
        return int(np.searchsorted(self.least, after + 1, "left"))

    def exits(self) -> list[tuple[int, int]]:
        """(entry, exit) wherever the exit changes: places of the last hit in the window before the piece, and in its own last window; -1 where it lies further back."""
        n = len(self.ends)
        last = list(range(n))
        for i in range(n - 1, -1, -1):
            if self.then[i] < n:
                last[i] = last[self.then[i]]
        out: list[tuple[int, int]] = []
        for entry in range(-1, self.before):
            i = self.from_here(entry)
            place = int(self.ends[last[i]]) - self.tail if i < n else -1
            if not out or out[-1][1] != max(-1, place):
                out.append((entry, max(-1, place)))
        return out

    def hits(self, entry: int) -> Iterator[tuple[int, int]]:
        """(first, last) event of each hit."""
        i, start = self.from_here(entry), entry + 1
        while i < len(self.ends):
            e = int(self.ends[i])
            yield max(start, int(self.opens[e])), e
            i, start = int(self.then[i]), e + 1


KEY = (*SCOPE, "rule", "key")


def _runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Each batch cut where a column of ``by`` changes."""
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for c in by:
            column = b.column(c)
            after, before = column.slice(1), column.slice(0, b.num_rows - 1)
            differs = pc.or_(pc.fill_null(pc.not_equal(after, before), False), pc.xor(pc.is_null(after), pc.is_null(before)))
            change[1:] |= differs.to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e > s:
                part = b.slice(s, e - s)
                yield tuple(part.column(c)[0].as_py() for c in by), part


def _seen(parts: Iterator[tuple[tuple, pa.RecordBatch]]) -> Iterator[Seen]:
    for _, b in parts:
        times, ids, hits = b.column("t").to_pylist(), b.column("id").to_pylist(), b.column("hits").to_pylist()
        values = b.column("value").to_pylist()
        for i, t in enumerate(times):
            yield Seen(t, ids[i], values[i] if hits[i] is None else hits[i], (b, i))


class _Chains:
    """Chains gathered until there are some, or until they hold on to many batches; their events are cut out together."""

    def __init__(self):
        self.keys: list[tuple] = []
        self.chains: list[list[tuple[pa.RecordBatch, int]]] = []
        self.held: dict[int, pa.RecordBatch] = {}

    def add(self, key: tuple, chain: list[tuple[pa.RecordBatch, int]]) -> bool:
        self.keys.append(key)
        self.chains.append(chain)
        self.held.update((id(b), b) for b, _ in chain)
        return len(self.chains) >= 4096 or len(self.held) >= 64

    def flush(self) -> pa.RecordBatch:
        starts, parts, n = {}, [], 0
        for k, b in self.held.items():
            starts[k] = n
            parts.append(b.column("event"))
            n += b.num_rows
        at = [starts[id(b)] + i for chain in self.chains for b, i in chain]
        events = pa.concat_arrays(parts).take(pa.array(at, pa.int64()))
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in self.chains])])
        *scope, rule, key = zip(*self.keys, strict=True)
        arrays = [*(pa.array(s, pa.string()) for s in scope), pa.array(rule, pa.int32()), pa.array(key, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), events)]
        self.__init__()
        return pa.RecordBatch.from_arrays(arrays, names=[*KEY, "chain"])


def _folded(rows: DataFrame, rules: list[Correlation], by: tuple[str, ...]) -> DataFrame:
    """(scope, rule, key, chain): the events of each group of ``by`` in time order, row by row; only open windows are held."""
    schema = T.StructType([*[rows.schema[c] for c in KEY], T.StructField("chain", T.ArrayType(rows.schema["event"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Chains()
        for key, own in groupby(_runs(batches, by), lambda x: x[0]):
            rule, events = rules[key[2]], _seen(own)
            for chain in sequence_chains(events, len(rule.stages), rule.window * 1_000_000) if rule.kind == "sequence" else counted_chains(events, rule):
                if out.add(key[:4], [e.at for e in chain]):
                    yield out.flush()
        if out.chains:
            yield out.flush()

    return rows.repartition(*by).sortWithinPartitions(*by, "t", "id", "tie").mapInArrow(run, schema)


def _relevant(base: DataFrame, entries: list[Column]) -> DataFrame:
    """A row for each event and rule that looks at it: scope, rule, key, t, id, hits, value, event, and a tie for events of one time and id. Events without a time take no part."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = base.where(F.col("ts").isNotNull()).select(*[F.col(c).cast("string").alias(c) for c in SCOPE], t.alias("t"), event_struct(base).alias("event"), F.explode(F.array(*entries)).alias("x"))
    return rows.where(F.col("x").isNotNull()).select(*SCOPE, "x.*", "t", F.col("event.event_id").alias("id"), "event").withColumn("tie", F.xxhash64("event"))


def _hot(rows: DataFrame, rules: list[Correlation]) -> list[tuple]:
    """(scope, rule, key, length of a piece in microseconds) of the keys with many events; any that has more than a ``HOT_KEYS``-th of all is among them, if it has more than ``HOT_ROWS``."""
    n = F.count("*")
    counts = rows.groupBy(*KEY).agg(n.alias("n"), F.min("t").alias("since"), F.max("t").alias("until")).where(F.col("n") > HOT_ROWS)
    top = counts.orderBy(F.col("n").desc()).limit(HOT_KEYS).collect()
    return [(*(r[c] for c in KEY), max(2 * rules[r.rule].window * 1_000_000, (r.until - r.since) * PIECE_ROWS // r.n + 1)) for r in top]


def _in_time(base: DataFrame, rules: list[Correlation], entries: list[Column]) -> DataFrame:
    """(scope, rule, key, chain) of all rules.

    One scan and one shuffle serve all keys but those with very many events, which are cut along time: sequences where
    no chain can be open, counts anywhere, with where the last hit ended carried over the cut.
    """
    rows = _relevant(base, entries)
    hot = _hot(rows.select(*KEY, "t"), rules)
    if not hot:
        return _folded(rows, rules, KEY)
    names = base.sparkSession.createDataFrame(hot, T.StructType([*[rows.schema[c] for c in KEY], T.StructField("length", T.LongType())]))
    marked = rows.join(F.broadcast(names), list(KEY), "left")  # HOT_KEYS rows at most
    cold = marked.where("length IS NULL").drop("length")
    cut = marked.where("length IS NOT NULL").withColumn("piece", F.expr("t div length - CASE WHEN t % length < 0 THEN 1 ELSE 0 END"))
    sequences = [i for i, r in enumerate(rules) if r.kind == "sequence"]
    is_sequence = F.col("rule").isin(sequences)
    out = _folded(cold, rules, KEY)
    kinds = {rules[h[2]].kind == "sequence" for h in hot}
    if True in kinds:
        out = out.union(_folded(_parted(cut.where(is_sequence), rules), rules, (*KEY, "part")))
    if False in kinds:
        out = out.union(_carried(cut.where(~is_sequence), rules))
    return out


def _by_rule(values: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("rule") + 1)


def _parted(rows: DataFrame, rules: list[Correlation]) -> DataFrame:
    """Rows of sequences with ``part``: a new one begins at an event of the first stage before which there was none for longer than the window.

    Times of the first stage are compared inside a piece; what comes from the pieces before is the last such time and
    the last beginning, a row for each piece. Rows that no chain can reach are dropped.
    """
    window = _by_rule([r.window * 1_000_000 for r in rules])
    first = F.when(F.col("hits").bitwiseAND(1) == 1, F.col("t"))
    inside = Window.partitionBy(*KEY, "piece").orderBy("t", "id", "tie")
    along = Window.partitionBy(*KEY).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)

    def carried(df: DataFrame, value: Column, name: str) -> DataFrame:
        pieces = df.groupBy(*KEY, "piece").agg(F.max(value).alias("_v")).withColumn(name, F.max("_v").over(along)).drop("_v")
        return df.join(pieces, [*KEY, "piece"])

    own = F.max(first).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = carried(rows, first, "_prior").withColumn("_prior", F.coalesce(own, F.col("_prior")))
    begins = F.when(first.isNotNull() & (F.col("_prior").isNull() | (F.col("t") - F.col("_prior") > window)), F.col("t"))
    rows = rows.withColumn("_begins", begins)
    rows = carried(rows, F.col("_begins"), "_part").withColumn("part", F.coalesce(F.max("_begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_part")))
    reached = first.isNotNull() | (F.col("t") - F.col("_prior") <= window)
    return rows.where(F.col("part").isNotNull() & reached).drop("_prior", "_begins", "_part", "length", "piece")


_EXITS = "entries array<int>, exits array<int>"


def _carried(rows: DataFrame, rules: list[Correlation]) -> DataFrame:
    """(scope, rule, key, chain) of thresholds and distinct counts, a piece of time for a task.

    Each piece also gets the events of the window before it. First every piece says where its last hit would end for
    each place where the last one before it may have ended; these answers, a row for each piece, are followed in order;
    then every piece gives its hits, knowing where it starts from.
    """
    window = _by_rule([r.window * 1_000_000 for r in rules])
    late = F.col("t") >= (F.col("piece") + 1) * F.col("length") - window
    places = F.explode(F.when(late, F.array("piece", F.col("piece") + 1)).otherwise(F.array("piece")))
    dealt = rows.withColumn("piece", places)
    by = (*KEY, "piece")
    keys = [rows.schema[c] for c in (*KEY, "piece")]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table, Piece]]:
        for key, own in groupby(_runs(batches, by), lambda x: x[0]):
            table = pa.Table.from_batches([b for _, b in own])
            length = next(v for v in table.column("length").to_pylist() if v is not None)
            rows_ = table.filter(pc.is_null(table.column("entry"))) if "entry" in table.column_names else table
            yield key, table, Piece(rows_.column("t").to_numpy(), rows_.column("value").to_pylist(), key[4] * length, (key[4] + 1) * length, rules[key[2]])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, piece in pieces(batches):
            entries, exits = zip(*piece.exits(), strict=True)
            yield pa.RecordBatch.from_pylist([dict(zip(by, key, strict=True)) | {"entries": list(entries), "exits": list(exits)}], schema=pa.schema([("run_id", pa.string()), ("scenario_id", pa.string()), ("rule", pa.int32()), ("key", pa.string()), ("piece", pa.int64()), ("entries", pa.list_(pa.int32())), ("exits", pa.list_(pa.int32()))]))

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, state = None, None, -1
        for b in batches:
            found = []
            for r in b.to_pylist():
                own = tuple(r[c] for c in KEY)
                if own != key or r["piece"] != last + 1:
                    state = -1
                found.append(state)
                state = r["exits"][bisect_right(r["entries"], state) - 1]
                key, last = own, r["piece"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in by), pa.array(found, pa.int32())], names=[*by, "entry"])

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Chains()
        for key, table, piece in pieces(batches):
            known = table.filter(pc.is_valid(table.column("entry")))
            events = table.filter(pc.is_null(table.column("entry"))).combine_chunks()
            for b in events.to_batches():  # one, as chunks are combined
                for first, last in piece.hits(known.column("entry")[0].as_py()):
                    if out.add(key[:4], [(b, i) for i in range(first, last + 1)]):
                        yield out.flush()
        if out.chains:
            yield out.flush()

    lean = dealt.select(*by, "t", "id", "tie", "value", "length")
    answers = lean.repartition(*by).sortWithinPartitions(*by, "t", "id", "tie").mapInArrow(asked, T.StructType([*keys[:4], T.StructField("piece", T.LongType()), *T._parse_datatype_string(_EXITS).fields]))
    known = answers.repartition(*KEY).sortWithinPartitions(*by).mapInArrow(followed, T.StructType([*keys[:4], T.StructField("piece", T.LongType()), T.StructField("entry", T.IntegerType())]))
    both = dealt.select(*by, "t", "id", "tie", "value", "length", "event").unionByName(known, allowMissingColumns=True)
    schema = T.StructType([*keys[:4], T.StructField("chain", T.ArrayType(rows.schema["event"].dataType))])
    return both.repartition(*by).sortWithinPartitions(*by, "t", "id", "tie").mapInArrow(hit, schema)


def _entry(number: int, rule: Correlation, fields: Callable[[str], Field | None]) -> Column:
    """struct(rule, key, hits, value) where the event is relevant to the rule, else null; a row whose key is missing takes no part."""
    rule.check()
    key = fields(rule.group_by)
    if key is None:
        raise RuleError(f"{rule.rule_id}: no field {rule.group_by}")
    hits, value = F.lit(None).cast("int"), F.lit(None).cast("string")
    if rule.kind == "sequence":
        hits = reduce(Column.__add__, [F.when(m, 1 << i).otherwise(0) for i, m in enumerate(_stages(rule, fields))]).cast("int")
        match = hits > 0
    else:
        match, own = selection(rule.select, fields), fields(rule.distinct_field) if rule.distinct_field else None
        value = F.when(own.known, own.text) if own else value
    known = F.when(key.known, key.text)
    return F.when(match & known.isNotNull(), F.struct(F.lit(number).alias("rule"), known.alias("key"), hits.alias("hits"), value.alias("value")))


def _stages(rule: Correlation, fields: Callable[[str], Field | None]) -> list[Column]:
    """What each stage matches and does not exclude."""
    out = []
    for i, spec in enumerate(rule.stages):
        match = selection(spec, fields)
        if i < len(rule.excludes) and rule.excludes[i]:
            match = match & ~selection(rule.excludes[i], fields)
        out.append(match)
    return out


def _of_stream(events: DataFrame, rule: Correlation, fields: Callable[[str], Field | None]) -> DataFrame:
    """(scope, key, chain) of one rule, from state for each key."""
    from ..streaming.processors import chains_of_stream

    event = lambda x: F.struct(*[(F.timestamp_micros(x["t"]) if n == "ts" else x["e"][n]).alias(n) for n in EVENT])
    return chains_of_stream(events, rule, fields).withColumn("chain", F.transform("chain", event))


def _alerts(found: DataFrame, head: Column, kind: Column) -> DataFrame:
    out = found.select(*SCOPE, head.alias("hit"), F.element_at("chain", -1).alias("event"), F.slice("chain", 1, F.size("chain") - 1).alias("supporting"), F.concat(kind, "key").alias("correlation_type"))
    return with_alert_id(out.select(*SCOPE, "hit.*", "event", "supporting", "correlation_type"))


def correlate_one(events: DataFrame, rule: Correlation, fields: Callable[[str], Field | None]) -> DataFrame:
    """Alerts of one rule; raises where it is broken."""
    entry = _entry(0, rule, fields)
    found = _of_stream(events, rule, fields) if events.isStreaming else _in_time(scoped(events), [rule], [entry])
    return _alerts(found, _head(rule), F.lit(f"{rule.kind}:{rule.group_by}="))


def correlate(events: DataFrame, rules: Iterable[Correlation], fields: Callable[[str], Field | None]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """(alerts of all enabled rules or None, errors): a broken rule stops no other. All rules on a table are one scan and one shuffle."""
    good, entries, bad = [], [], []
    for r in rules:
        if r.enabled:
            try:
                entries.append(_entry(len(good), r, fields))
                good.append(r)
            except RuleError as e:
                bad.append((r.rule_id, str(e)))
    if not good:
        return None, bad
    if events.isStreaming:
        return reduce(DataFrame.unionByName, [correlate_one(events, r, fields) for r in good]), bad
    at = F.col("rule") + 1
    pick = lambda values: F.element_at(F.array(*values), at)
    return _alerts(_in_time(scoped(events), good, entries), pick([_head(r) for r in good]), pick([F.lit(f"{r.kind}:{r.group_by}=") for r in good])), bad
