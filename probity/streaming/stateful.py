"""Streams whose verdicts don't depend on the order in which records arrive: hash chains
and single-use nonces. Both keep what came too early in keyed state and settle it in
event-time order, by timers that the watermark sets off, so the stream's verdicts
are the batch query's. Records later than the watermark are dropped by Spark.

State lives in RocksDB: call keep_state_in_rocksdb() before a query starts.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from probity.operators.ledger import GENESIS

# the driver's process that starts a stateful operator knows no added files: send the classes themselves
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Chain(StatefulProcessor):
    """State: the next place, the last hash and the verdict so far; records that wait for
    those before them; the time of the last record."""

    def __init__(self, first: int, idle_ms: int) -> None:
        self.first, self.idle_ms = first, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.verdict = handle.getValueState("verdict", "place long, records long, last string, first_break long, latest long")
        self.waiting = handle.getMapState("waiting", "place long", "own string, prev string")

    def _settle(self, state: list, place: int) -> None:
        """Take the waiting record at place as the chain's next one."""
        own, prev = self.waiting.getValue((place,))
        self.waiting.removeKey((place,))
        if prev != state[2] and state[3] is None:
            state[3] = place
        state[:3] = place + 1, state[1] + 1, own

    def _row(self, key: Any, state: list, waits: int, closed: bool) -> Row:
        return Row(chain=key[0], records=state[1], waits=waits, ok=state[3] is None, first_break=state[3], closed=closed)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802,N803
        state = list(self.verdict.get()) if self.verdict.exists() else [self.first, 0, GENESIS, None, 0]
        for r in rows:
            # a record that was settled or waits already came twice
            if r["place"] >= state[0] and not self.waiting.containsKey((r["place"],)):
                self.waiting.updateValue((r["place"],), (r["own"], r["prev"]))
            state[4] = max(state[4], r["at_ms"])
        while self.waiting.containsKey((state[0],)):
            self._settle(state, state[0])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(state[4] + self.idle_ms)
        self.verdict.update(tuple(state))
        yield self._row(key, state, sum(1 for _ in self.waiting.keys()), False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802,N803
        """The chain has been idle: what waits comes after a gap, as the batch query sees it."""
        state = list(self.verdict.get())
        for place in sorted(k[0] for k in self.waiting.keys()):
            self._settle(state, place)
        self.verdict.clear()
        self.waiting.clear()
        yield self._row(key, state, 0, True)


def _ms(at: Column) -> Column:
    return F.unix_millis(at.cast("timestamp")).alias("at_ms")


def chain_verdicts(records: DataFrame, chain: str, place: str, own: str, prev: str, at: str, first: int = 0, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """Per chain and batch (update mode): records settled so far, waits (those that came
    before the one ahead of them), ok, first_break, closed. Places count from first. A
    chain without records for idle_ms of event time is closed: its verdict is final, as
    operators.ledger.chain_breaks() gives it, and its state goes."""
    rows = records.withWatermark(at, late).select(F.col(chain).cast("string").alias("chain"), F.col(place).cast("long").alias("place"), F.col(own).alias("own"), F.col(prev).alias("prev"), at, _ms(F.col(at)))
    schema = "chain string, records long, waits long, ok boolean, first_break long, closed boolean"
    return rows.groupBy("chain").transformWithState(_Chain(first, idle_ms), schema, "Update", "EventTime")


class _Nonces(StatefulProcessor):
    """A bucket of nonces. State: of each nonce when it was issued, whether it is consumed,
    until when it is kept and up to HELD uses that wait for the watermark to pass them, as
    JSON; any more of them have rows of their own. Each call on the state is a message to
    Spark, so a bucket is read and written once and has one timer, for what comes next."""

    HELD = 64

    def __init__(self, ttl_ms: int, keep_ms: int) -> None:
        self.ttl_ms, self.keep_ms = ttl_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("nonces", "nonces string, timer long, more boolean")
        self.waiting = handle.getMapState("uses", "nonce string, at_ms long, use_id string", "seen boolean")

    def _load(self) -> tuple[dict, int | None, bool]:
        """nonce -> [issued, consumed, until, waiting uses]; the next timer; whether uses have rows of their own."""
        if not self.state.exists():
            return {}, None, False
        text, timer, more = self.state.get()
        return {nonce: [issued, consumed, until, {tuple(u) for u in uses}] for nonce, issued, consumed, until, uses in json.loads(text)}, timer, more

    def _keep(self, nonces: dict, timer: int, more: bool) -> None:
        self.state.update((json.dumps([[nonce, *kept, sorted(uses)] for nonce, (*kept, uses) in nonces.items()]), timer, more))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802,N803
        nonces, timer, more = self._load()
        ahead = []
        for r in rows:
            at, use_id = r["at_ms"], r["use_id"]
            own = nonces.setdefault(r["nonce"], [None, False, 0, set()])
            if use_id is None:
                own[0] = at if own[0] is None else min(own[0], at)
            elif len(own[3]) < self.HELD:
                own[3].add((at, use_id))
            elif (at, use_id) not in own[3]:
                self.waiting.updateValue((r["nonce"], at, use_id), (True,))
                more = True
            own[2] = max(own[2], at + self.keep_ms)
            ahead.append(own[2] if use_id is None else at + 1)
        if ahead and (timer is None or min(ahead) < timer):
            timer = min(ahead)
            self.handle.registerTimer(timer)
        self._keep(nonces, timer, more)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802,N803
        """Settle all that the watermark has passed, forget what needn't be kept."""
        nonces, _, more = self._load()
        now, ahead, left = timerValues.getCurrentWatermarkInMs(), [], False
        others: dict[Any, set] = {}
        for nonce, at, use_id in self.waiting.keys() if more else ():
            others.setdefault(nonce, set()).add((at, use_id))
        for nonce, own in list(nonces.items()):
            issued, consumed, until, held = own
            apart = others.get(nonce, set())
            waits = held | apart
            due = sorted(use for use in waits if use[0] < now)
            for use in due:
                if use in apart:
                    self.waiting.removeKey((nonce, *use))
                known = issued is not None and issued <= use[0]
                verdict = "unknown" if not known else "replayed" if consumed else "expired" if use[0] - issued > self.ttl_ms else "released"
                consumed = consumed or known
                yield Row(nonce=nonce, use_id=use[1], verdict=verdict)
            own[1], own[3] = consumed, held.difference(due)
            left = left or len(apart.difference(due)) > 0
            after = min((at + 1 for at, _ in waits.difference(due)), default=until)
            if after > now:
                ahead.append(after)
            else:
                del nonces[nonce]
        if not nonces:
            self.state.clear()
            return
        self.handle.registerTimer(min(ahead))
        self._keep(nonces, min(ahead), left)


def nonce_verdicts(issues: DataFrame, uses: DataFrame, nonce: str, at: str, use_id: str, ttl_ms: int, keep_ms: int | None = None, late: str = "10 minutes", buckets: int = 2048) -> DataFrame:
    """(nonce, use_id, verdict) of each use of issues (nonce, at) and uses (nonce, use_id, at),
    once the watermark has passed it (append mode): unknown (not issued by then), expired
    (first use, later than the time to live), released (first use) or replayed. A nonce
    is forgotten keep_ms after its last record, four times the time to live by default; its
    later uses are unknown. Equal to operators.ledger.nonce_verdicts() but for that. State
    is kept by buckets of nonces' hashes; their number holds for a stream's whole life."""
    part = lambda df, use: df.select(F.col(nonce).cast("string").alias("nonce"), use.cast("string").alias("use_id"), F.col(at).alias("at"))
    both = part(issues, F.lit(None)).unionByName(part(uses, F.col(use_id))).withWatermark("at", late)
    processor = _Nonces(ttl_ms, 4 * ttl_ms if keep_ms is None else keep_ms)
    bucket = F.pmod(F.xxhash64("nonce"), F.lit(buckets)).alias("bucket")
    return both.select("*", _ms(F.col("at")), bucket).groupBy("bucket").transformWithState(processor, "nonce string, use_id string, verdict string", "Append", "EventTime")
