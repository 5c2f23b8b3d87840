"""Optimistic edit acceptance: an edit is taken only when it was based on the current head."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import merge

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTCOME = "run_id long, seq long, sha256 string, head string, status int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Edits of a run that one micro-batch may bring before they are ordered in the state store, and rows of an answer.
IN_MEMORY, ANSWER = 2_000, 1_000
ACCEPTED, STALE = 200, 409


class EditDecider(StatefulProcessor):
    """Decides the edits of a run one by one.

    State: the run's head and the highest number decided, and a map of edits by number that waits for its
    turn: those of a large micro-batch while it is ordered, or, with ``hold_ms``, all edits until the watermark
    says that none before them is still to come. Then an event-time timer gives each its turn, and it leaves the map.
    """

    def __init__(self, hold_ms: int | None):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "head string, done long")
        self.waiting = handle.getMapState("waiting", "seq long", "base_sha string, sha256 string, root_sha string, at long")

    def _decide(self, run_id: int, edits: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        """``edits`` (seq, base, sha256, root) in order; answers in parts."""
        head, done = self.head.get() if self.head.exists() else (None, -1)
        out = []
        for seq, base, sha256, root in edits:
            head = root if head is None else head
            accepted = seq > done and base == head
            head, done = sha256 if accepted else head, max(done, seq)
            out.append((run_id, seq, sha256, head, ACCEPTED if accepted else STALE))
            if len(out) == ANSWER:
                yield _answer(out)
                out = []
        self.head.update((head, done))
        if out:
            yield _answer(out)

    def _taken(self, numbers: list[int]) -> Iterator[tuple]:
        for seq in sorted(numbers):
            base, sha256, root, _ = self.waiting.getValue((seq,))
            self.waiting.removeKey((seq,))
            yield seq, base, sha256, root

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        late: list[tuple] = []
        numbers: list[int] = []
        now = timerValues.getCurrentWatermarkInMs() if self.hold_ms is not None else None
        for frame in rows:
            at = frame["ts"].astype("datetime64[ms]").astype("int64") if self.hold_ms is not None else [0] * len(frame)
            for seq, base, sha256, root, t in zip(frame["seq"], frame["base_sha"], frame["sha256"], frame["root_sha"], at):
                if self.hold_ms is None:
                    held.append((int(seq), base, sha256, root))
                    if len(held) >= IN_MEMORY:
                        numbers += self._park(held)
                        held = []
                elif int(t) + self.hold_ms <= now:
                    late.append((int(seq), base, sha256, root))
                else:
                    self.waiting.updateValue((int(seq),), (base, sha256, root, int(t)))
                    self.handle.registerTimer(int(t) + self.hold_ms)
        if self.hold_ms is not None:
            if late:  # answered at once, after those that were due before them and whose timers have yet to run
                due = [k[0] for k, v in self.waiting.iterator() if v[3] + self.hold_ms <= now]
                yield from self._decide(key[0], merge(self._taken(due), sorted(late)))
        elif numbers:
            yield from self._decide(key[0], self._taken(numbers + self._park(held)))
        elif held:
            yield from self._decide(key[0], iter(sorted(held)))

    def _park(self, held: list[tuple]) -> list[int]:
        for seq, base, sha256, root in held:
            self.waiting.updateValue((seq,), (base, sha256, root, 0))
        return [h[0] for h in held]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() - self.hold_ms
        ready = [k[0] for k, v in self.waiting.iterator() if v[3] <= due]
        if ready:
            yield from self._decide(key[0], self._taken(ready))

    def close(self) -> None:
        pass


def _answer(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["run_id", "seq", "sha256", "head", "status"])


def interval_ms(spark: SparkSession, interval: str) -> int:
    """Milliseconds of an interval as in "10 seconds"."""
    end = F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {interval}")
    return spark.range(1).select(F.unix_millis(end).alias("ms")).first().ms


def accept_edits(edits: DataFrame, hold: str | None = None) -> DataFrame:
    """Accepted (200) and stale (409) edits per run.

    edits(run_id, seq, base_sha, sha256, root_sha[, ts]). An edit that comes after a higher number was decided is
    stale. Without ``hold`` the edits that one micro-batch brings for a run are decided in the order of their numbers,
    at once. With ``hold``, as in "10 seconds", an edit waits until the watermark has passed its ``ts`` by that much, so that
    edits that arrive out of order between micro-batches are put in order; later ones are answered at once.

    Numbers are unique within a run. State lives in the RocksDB store, so a run's waiting edits need no memory.
    """
    spark = edits.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    typed = edits.select("run_id", "seq", "base_sha", "sha256", "root_sha", *(["ts"] if hold else []))
    if hold is None:
        return typed.groupBy("run_id").transformWithStateInPandas(EditDecider(None), OUTCOME, "append", "None")
    keyed = typed.withWatermark("ts", "0 seconds").groupBy("run_id")
    return keyed.transformWithStateInPandas(EditDecider(interval_ms(spark, hold)), OUTCOME, "append", "EventTime")
