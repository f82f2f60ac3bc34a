"""Arcs: what a place went through from the first signs to a grade, as a state machine over typed events.

An arc opens in `buildup` when a score rises by more than `rise` with `active` domains or more at work, and no arc is open;
a claim takes it to `recognition`, or opens one there, and sets a deadline; severe signals take it to `outcome`; a grade, or the
deadline, takes it to `grade`, and it is `closed` some time later. A buildup that no claim follows closes by itself. At any time
one arc a key is open. Events of a key are taken in the order of time, equal times by kind (score, claim, signal, grade);
what is due at a time comes before the events of that time.

The machine is a fold over a small state, so the batch form streams through sorted partitions, and the stream keeps it beside
the events that the watermark has not yet passed: both give the same acts whatever the order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KINDS = ("score", "claim", "signal", "grade")
#: key, kind (one of KINDS), time, and by kind: score and domains at work, or the grade's name.
EVENTS = "key string, kind string, at timestamp, score double, domains int, grade string"
#: Number of the arc in its key, act it enters, time, signals so far, and why (an event's kind, deadline or timeout).
ACTS = "key string, arc long, act string, at timestamp, signals long, grade string, why string"
_DAY = 86_400_000_000


@dataclass(frozen=True)
class Rules:
    rise: float = 15.0
    active: int = 2
    deadline_days: int = 7
    buildup_days: int = 14
    linger_days: int = 1
    confirmed: int = 1  # signals that a deadline counts as a hit


@dataclass
class Arc:
    """What is kept of a key, times in microseconds: the last score (NaN for none), the number of arcs so far, the act of the open one
    (empty for none), when it is due, its signals and its grade."""

    last: float = float("nan")
    arcs: int = 0
    act: str = ""
    due: int = 0
    signals: int = 0
    grade: str = ""

    def _enter(self, act: str, at: int, why: str, due: int) -> tuple:
        self.act, self.due = act, due
        return self.arcs, act, at, self.signals, self.grade or None, why

    def _open(self, act: str, at: int, why: str, due: int) -> tuple:
        self.arcs, self.signals, self.grade = self.arcs + 1, 0, ""
        return self._enter(act, at, why, due)

    def pass_time(self, now: int, rules: Rules) -> Iterator[tuple]:
        """The acts that are due up to a time."""
        while self.act and self.due <= now:
            at = self.due
            if self.act in ("recognition", "outcome"):
                self.grade = "confirmed" if self.signals >= rules.confirmed else "missed"
                yield self._enter("grade", at, "deadline", at + rules.linger_days * _DAY)
            else:
                row = self._enter("closed", at, "timeout", 0)
                self.act = ""
                yield row

    def take(self, kind: str, at: int, score: float, domains: int, grade: str, rules: Rules) -> Iterator[tuple]:
        """What an event does, after what was due before it."""
        yield from self.pass_time(at, rules)
        if kind == "score":
            if not self.act and score - self.last > rules.rise and domains >= rules.active:  # false for no last score
                yield self._open("buildup", at, kind, at + rules.buildup_days * _DAY)
            self.last = score
        elif kind == "claim" and self.act in ("", "buildup"):
            enter = self._enter if self.act else self._open
            yield enter("recognition", at, kind, at + rules.deadline_days * _DAY)
        elif kind == "signal" and self.act in ("recognition", "outcome"):
            self.signals += 1
            yield self._enter("outcome", at, kind, self.due)
        elif kind == "grade" and self.act in ("recognition", "outcome"):
            self.grade = grade
            yield self._enter("grade", at, kind, at + rules.linger_days * _DAY)


def _prepared(events: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int")
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    return events.where(F.col("key").isNotNull() & F.col("at").isNotNull() & (order > 0)).select(
        F.col("key").cast("string").alias("key"), micros.alias("us"), order.alias("kind"), F.coalesce(F.col("score").cast("double"), F.lit(float("nan"))).alias("score"), F.coalesce(F.col("domains").cast("int"), F.lit(0)).alias("domains"), F.coalesce("grade", F.lit("")).alias("grade"),
    )


#: Within a key events go by these; rows equal in all are equal to the machine.
_ORDER = ["us", "kind", "score", "domains", "grade"]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "arc", "act", "us", "signals", "grade", "why"])
    out["at"] = pd.to_datetime(out["us"].astype("int64"), unit="us")
    return out.astype({"arc": "int64", "signals": "int64", "grade": object})[["key", "arc", "act", "at", "signals", "grade", "why"]]


def arc_acts(events: DataFrame, as_of: str, rules: Rules = Rules()) -> DataFrame:
    """The acts of all keys (ACTS) up to a time. Partitions are sorted by key and time and streamed through: a task holds the state of
    one key, however many events that key has."""
    end = int(pd.Timestamp(as_of).value // 1000)

    def fold(batches):
        key, arc = None, Arc()
        for batch in batches:
            out = []
            for k, us, kind, score, domains, grade in batch.itertuples(index=False):
                if k != key:
                    out += [(key, *row) for row in arc.pass_time(end, rules)]
                    key, arc = k, Arc()
                out += [(key, *row) for row in arc.take(KINDS[kind - 1], us, score, domains, grade, rules)]
            if out:
                yield _frame(out)
        out = [(key, *row) for row in arc.pass_time(end, rules)]
        if out:
            yield _frame(out)

    rows = _prepared(events).where(F.col("us") <= end).select("key", *_ORDER)
    return rows.repartition("key").sortWithinPartitions("key", *_ORDER).mapInPandas(fold, ACTS)


class _Machine(StatefulProcessor):
    """State of a key: the arc; the events that the watermark has not passed; the timers that are set."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arc = handle.getValueState("arc", "last double, arcs long, act string, due long, signals long, grade string")
        self.pending = handle.getListState("pending", "us long, kind int, score double, domains int, grade string")

    def handleInputRows(self, key, rows, timerValues):
        now, new = timerValues.getCurrentWatermarkInMs(), []
        for batch in rows:
            new += [tuple(x) for x in batch[_ORDER].itertuples(index=False)]
        # Rows that the watermark has passed are late and were left out of the input; all others wait for it.
        for us in {x[0] for x in new}:
            self.handle.registerTimer(max(us // 1000, now + 1))
        self.pending.appendList([(int(u), int(k), float(s), int(d), str(g)) for u, k, s, d, g in new])
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        arc = Arc(*self.arc.get()) if self.arc.exists() else Arc()
        waiting = sorted(tuple(x) for x in self.pending.get()) if self.pending.exists() else []
        rows = []
        for us, kind, score, domains, grade in waiting:
            if us < now:
                rows += arc.take(KINDS[kind - 1], us, score, domains, grade, self.rules)
        rows += arc.pass_time(now - 1, self.rules)
        left = [x for x in waiting if x[0] >= now]
        self.pending.put(left) if left else self.pending.clear()
        self.arc.update(astuple(arc))
        if arc.act:
            self.handle.registerTimer(max(arc.due // 1000, now // 1000 + 1))
        yield _frame([(key[0], *row) for row in rows]) if rows else pd.DataFrame()

    def close(self) -> None:
        pass


def arc_stream(events: DataFrame, rules: Rules = Rules(), late: str = "1 day") -> DataFrame:
    """arc_acts() of a stream of EVENTS: an act is said once the watermark, `late` behind the newest event, has passed it. Needs
    the RocksDB state store (spark.sql.streaming.stateStore.providerClass), as Spark's arbitrary state with timers does."""
    rows = _prepared(events).withColumn("at", F.timestamp_micros("us")).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(_Machine(rules), ACTS, "Append", "EventTime")
