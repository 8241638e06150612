"""Token bucket and circuit breaker as stateful stream processors.

State per key is a few numbers. Set spark.sql.streaming.stateStore.providerClass
to the RocksDB provider, so that state lives outside the heap, and a checkpoint
location in the shared folder. Within a micro-batch, rows of a key are taken in
order of time; a row that comes in a later batch with an earlier time refills
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.service import _ACQUIRED, COOLDOWN_MS, FAILURES, TTL_MS, Breaker, acquire

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_MS = 86_400_000


def token_bucket_stream(requests: DataFrame, capacity: float = 60, rate: float = 1.0, ttl_ms: int = TTL_MS) -> DataFrame:
    """The streaming form of operators.service.token_bucket, for a stream (key, request_id, ts_ms, cost)."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (0.0, -1)
        last = None if last < 0 else last
        pdf = pd.concat(list(batches)).sort_values(["ts_ms", "request_id"], kind="stable")
        out = []
        for ts, cost in zip(pdf["ts_ms"], pdf["cost"], strict=True):
            ok, tokens, retry, last = acquire(tokens, last, int(ts), max(1, int(cost)), capacity, rate, ttl_ms)
            out.append((ok, tokens, retry))
        pdf[["allowed", "tokens", "retry_ms"]] = out
        state.update((float(tokens), int(last)))
        state.setTimeoutDuration(ttl_ms)
        yield pdf[["key", "request_id", "ts_ms", "cost", "allowed", "tokens", "retry_ms"]]

    d = requests.select(F.col("key").cast("string").alias("key"), F.col("request_id").cast("long").alias("request_id"), F.col("ts_ms").cast("long").alias("ts_ms"), F.col("cost").cast("int").alias("cost"))
    return d.groupBy("key").applyInPandasWithState(step, _ACQUIRED, "tokens double, last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def breaker_stream(calls: DataFrame, failures: int = FAILURES, cooldown_ms: int = COOLDOWN_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """The streaming form of operators.service.circuit_breaker, for a stream (key, call_id, ts_ms, failed)."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        run, opened = state.get if state.exists else (0, -1)
        b = Breaker(failures, cooldown_ms, run, None if opened < 0 else opened)
        pdf = pd.concat(list(batches)).sort_values(["ts_ms", "call_id"], kind="stable")
        pdf[["state", "passed"]] = [b.call(int(t), bool(f)) for t, f in zip(pdf["ts_ms"], pdf["failed"], strict=True)]
        state.update((b.run, -1 if b.opened is None else b.opened))
        state.setTimeoutDuration(idle_ms)
        yield pdf

    d = calls.select(F.col("key").cast("string").alias("key"), F.col("call_id").cast("long").alias("call_id"), F.col("ts_ms").cast("long").alias("ts_ms"), F.col("failed").cast("boolean").alias("failed"))
    return d.groupBy("key").applyInPandasWithState(step, "key string, call_id long, ts_ms long, failed boolean, state string, passed boolean", "run int, opened long", "append", GroupStateTimeout.ProcessingTimeTimeout)
