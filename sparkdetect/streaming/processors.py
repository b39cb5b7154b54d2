"""State of streams: open chains of a correlation, and baselines of entities."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.fields import Field
from ..operators.baseline import EPSILON, MAD_SCALE, Known
from ..operators.correlate import Seen, _entry, counted_chains, sequence_chains
from ..operators.detect import EVENT, SCOPE, event_struct, scoped
from ..operators.rules import Correlation

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def typed_state(spark: SparkSession) -> None:
    """Lists and maps as state need a store that writes single entries."""
    if spark.conf.get(STORE, "") != ROCKS:
        spark.conf.set(STORE, ROCKS)


class ChainProcessor(StatefulProcessor):
    """Chains of one key, as soon as the watermark has passed the event that completes them.

    Rows wait until the watermark has passed them, then they are taken in order of time. What stays is the events that
    may still be part of a chain: of a count those since its last hit, of a sequence those of the last window that no
    chain has used. A timer at the earliest waiting row, or at the end of the last window, drives both.
    """

    ROWS = "t long, id string, tie long, hits int, value string, event string"

    def __init__(self, rule: Correlation):
        self.rule, self.window = rule, rule.window * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.ROWS)
        self.open = handle.getListState("open", self.ROWS)
        self.used = handle.getMapState("used", "id string", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r["t"], r["id"], r["tie"], r["hits"], r["value"], r["event"]) for r in rows]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(-(-min(r[0] for r in new) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in rows if r[0] <= until), key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
        later = [r for r in rows if r[0] > until]
        if ready:
            self._keep(self.waiting, later)
        held = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        chains, left = self._sequences(held, ready, until) if self.rule.kind == "sequence" else self._counts(held, ready, until)
        if ready or len(left) != len(held):
            self._keep(self.open, left)
        # woken again for what waits, or to forget
        ahead = [-(-min(r[0] for r in later) // 1000)] if later else []
        if left:
            ahead.append(-(-(max(r[0] for r in left) + self.window) // 1000) + 1)
        for at in ahead:
            self.handle.registerTimer(at)
        return iter([Row(run_id=key[0], scenario_id=key[1], key=key[2], chain=json.dumps([{"t": e.t, "e": json.loads(e.at[5])} for e in chain])) for chain in chains])

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        elif state.exists():
            state.clear()

    @staticmethod
    def _seen(rows: list[tuple]) -> list[Seen]:
        return [Seen(r[0], r[1], r[4] if r[3] is None else r[3], r) for r in rows]

    def _counts(self, held: list[tuple], ready: list[tuple], until: int) -> tuple[list[list[Seen]], list[tuple]]:
        """What was held came to no hit, so it may go through the count once more before what is new."""
        rows = held + ready
        chains = list(counted_chains(self._seen(rows), self.rule))
        if chains:
            last = chains[-1][-1].at
            rows = rows[max(i for i, r in enumerate(rows) if r is last) + 1 :]
        return chains, [r for r in rows if r[0] >= until - self.window]

    def _sequences(self, held: list[tuple], ready: list[tuple], until: int) -> tuple[list[list[Seen]], list[tuple]]:
        """An earlier start is complete whenever a later one is, so a chain that is complete is final."""
        used = {k[0]: v[0] for k, v in self.used.iterator()} if self.used.exists() else {}
        rows = held + [r for r in ready if r[1] not in used]
        chains = list(sequence_chains(self._seen(rows), len(self.rule.stages), self.window))
        taken = {e.id: e.t for chain in chains for e in chain}
        for name, t in taken.items():
            self.used.updateValue((name,), (t,))
        for name, t in used.items():  # rows of one id lie near each other
            if t < until - self.window:
                self.used.removeKey((name,))
        return chains, [r for r in rows if r[1] not in taken and r[0] >= until - self.window]

    def close(self) -> None:
        pass


def chains_of_stream(events: DataFrame, rule: Correlation, fields: Callable[[str], Field | None]) -> DataFrame:
    """(scope, key, chain) of one rule; ``events`` carry a watermark on ts."""
    typed_state(events.sparkSession)
    base = scoped(events)
    payload = [n for n in EVENT if n != "ts"]
    kinds = event_struct(base)
    rows = base.withColumns({"_event": kinds, "x": _entry(0, rule, fields)}).where("x IS NOT NULL AND ts IS NOT NULL")
    lean = rows.select(
        *[F.col(c).cast("string").alias(c) for c in SCOPE], F.col("x.key").alias("key"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("_event.event_id").alias("id"), F.xxhash64("_event").alias("tie"), F.col("x.hits").alias("hits"), F.col("x.value").alias("value"), F.to_json(F.struct(*[F.col(f"_event.{n}").alias(n) for n in payload])).alias("event"),
    )
    out = lean.groupBy(*SCOPE, "key").transformWithState(ChainProcessor(rule), "run_id string, scenario_id string, key string, chain string", "Append", "EventTime")
    inner = ", ".join(f"{n}: string" for n in payload)
    return out.withColumn("chain", F.from_json("chain", f"array<struct<t: bigint, e: struct<{inner}>>>"))


class BaselineProcessor(StatefulProcessor):
    """Each event of an entity is judged by those before it, then learnt. Only the features that an event has are read and written."""

    def __init__(self, min_samples: int, threshold: float, recent: int, pause: int):
        self.min_samples, self.threshold, self.recent, self.pause = min_samples, threshold, recent, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getValueState("events", "n long, last long")
        self.known = handle.getMapState("known", "feature string", "n long, mean double, m2 double, recent array<double>")

    def _of(self, feature: str) -> Known | None:
        if not self.known.containsKey((feature,)):
            return None
        own = Known(self.recent)
        own.n, own.mean, own.m2, lately = self.known.getValue((feature,))
        own.lately.extend(lately)
        own.ordered = sorted(lately)
        return own

    def _score(self, own: Known | None, value: float, events: int) -> tuple[float, str, int]:
        if own is None:
            return (math.inf, "feature_novelty", events) if events >= self.min_samples else (0.0, "insufficient_samples", 0)
        if own.n < self.min_samples:
            return 0.0, "insufficient_samples", own.n
        n, mean, spread, centre, mad = own.figures()
        scale, off = MAD_SCALE * mad, abs(value - mean)
        if scale > EPSILON:
            return abs(value - centre) / scale, "median_mad", n
        if spread > EPSILON:
            return off / spread, "welford_zscore", n
        return (0.0 if off <= EPSILON else math.inf), "zero_variance", n

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events, last = tuple(self.events.get()) if self.events.exists() else (0, None)
        touched: dict[str, Known] = {}
        out = []
        ordered = sorted(rows, key=lambda r: (r["ts"], r["event_id"], r["feature"], r["value"]))
        for (ts, event), own in groupby(ordered, key=lambda r: (r["ts"], r["event_id"])):
            for r in own:
                feature, value = r["feature"], r["value"]
                known = touched.get(feature) or self._of(feature)
                score, method, n = self._score(known, value, events)
                if score >= self.threshold:
                    out.append(Row(event_id=event, ts=ts, entity=key[0], feature=feature, value=value, score=score, sample_count=n, method=method))
                known = touched[feature] = known or Known(self.recent)
                known.learn(value)
            events += 1
            last = max(last or 0, int(ts.timestamp() * 1000))
        for feature, k in touched.items():
            self.known.updateValue((feature,), (k.n, k.mean, k.m2, list(k.lately)))
        self.events.update((events, last))
        if self.pause:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
            self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.pause)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.events.clear()
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass
