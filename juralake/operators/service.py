"""Policy: quota (batch), circuit breaker (batch), roles, redaction, dispatch, similarity search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: role, rank, capacity, tokens a second; fallback is for an outage of the quota store.
ROLES = (("Reader", 1, 60, 1.0), ("Navigator", 2, 120, 2.0), ("Validator", 3, 240, 4.0))
FALLBACK = (5, 0.5)
TTL_MS = 60_000
#: Pools whose calls leave the local store cost five.
POOL_COST = {"LocalNavigation": 1, "Discovery": 5, "JoluxMetadata": 5}
FAILURES, COOLDOWN_MS = 5, 30_000
REDACTED = "[REDACTED]"


def role_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ROLES), "role string, rank int, capacity int, refill double")


def refill(tokens: float, last_ms: int | None, now_ms: int, capacity: float, rate: float, ttl_ms: int = TTL_MS) -> float:
    """Tokens at now. A bucket that nobody used for ``ttl_ms`` is forgotten, and so full; a clock that went back refills nothing."""
    if last_ms is None or now_ms - last_ms >= ttl_ms:
        return float(capacity)
    return min(float(capacity), tokens + max(0, now_ms - last_ms) / 1000 * rate)


def acquire(tokens: float, last_ms: int | None, now_ms: int, cost: float, capacity: float, rate: float, ttl_ms: int = TTL_MS) -> tuple[bool, float, int, int]:
    """allowed, tokens left, retry_ms (0 if allowed, -1 if it never will be), time of the state. A refusal takes nothing."""
    have = refill(tokens, last_ms, now_ms, capacity, rate, ttl_ms)
    at = now_ms if last_ms is None else max(last_ms, now_ms)
    if have >= cost:
        return True, have - cost, 0, at
    return False, have, -1 if rate <= 0 else math.ceil((cost - have) / rate * 1000), at


_ACQUIRED = "key string, request_id long, ts_ms long, cost int, allowed boolean, tokens double, retry_ms long"


_ARROW = {"boolean": pa.bool_(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _in_order(rows: DataFrame, start: Callable[[], Callable], schema: str, added: int) -> DataFrame:
    """rows(key, id, ts_ms, ...) of each key, in order of time (ties: id), through a function of their own: start() makes one, which takes a row's values but the key and returns the last ``added`` columns of the schema.

    A state depends on every row before, so a key is one sequence; keys spread over the cluster. Rows come sorted and in batches, so a task holds a batch and one state, not a key's rows. Rows without a time come first.
    """
    fields = [(n, _ARROW[t]) for n, t in (x.split() for x in schema.split(", "))]
    new = fields[len(fields) - added :]

    def run(batches):
        key, fn = None, None
        for b in batches:
            out = []
            for k, *values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if fn is None or k != key:
                    key, fn = k, start()
                out.append(fn(*values))
            kept = [b.column(n) for n, _ in fields[: len(fields) - added]]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(new))], [n for n, _ in fields])

    return rows.repartition("key").sortWithinPartitions("key", "ts_ms", rows.columns[1]).mapInArrow(run, schema)


def _requests(requests: DataFrame) -> DataFrame:
    return requests.select(*(F.col(c).cast(t).alias(c) for c, t in (("key", "string"), ("request_id", "long"), ("ts_ms", "long"), ("cost", "int"))), *(c for c in ("capacity", "rate") if c in requests.columns))


def _bucket():
    tokens, last = 0.0, None

    def take(_, ts, cost, capacity, rate):
        nonlocal tokens, last
        if capacity is None or ts is None:  # no role that has a bucket, or no time
            return False, tokens, -1
        ok, tokens, retry, last = acquire(tokens, last, ts, max(1, cost or 1), capacity, rate)
        return ok, tokens, retry

    return take


def token_bucket(requests: DataFrame, capacity: float = 60, rate: float = 1.0) -> DataFrame:
    """Each request(key, request_id, ts_ms, cost) with the bucket's decision, in order of time (ties: id) within the key. A null cost counts as 1."""
    d = _requests(requests).withColumn("capacity", F.lit(float(capacity))).withColumn("rate", F.lit(float(rate)))
    return _in_order(d, _bucket, _ACQUIRED, 3)


def quota_decisions(requests: DataFrame, store_up: bool = True) -> DataFrame:
    """token_bucket with each role's limits for requests(key, request_id, ts_ms, cost, role), every one of which gets a row. A key has one bucket, whatever roles use it; a null or unknown role is refused for good. While the store is down every key has the small fallback bucket, and ``degraded`` is set."""
    if not store_up:
        return token_bucket(requests, *FALLBACK).withColumn("degraded", F.lit(True))
    of = lambda at: F.coalesce(*(F.when(F.col("role") == r[0], F.lit(float(r[at]))) for r in ROLES))
    d = _requests(requests.withColumn("capacity", of(2)).withColumn("rate", of(3)))
    return _in_order(d, _bucket, _ACQUIRED, 3).withColumn("degraded", F.lit(False))


@dataclass
class Breaker:
    """Closed until ``failures`` in a row; then open for ``cooldown`` ms; then one call decides."""

    failures: int = FAILURES
    cooldown: int = COOLDOWN_MS
    run: int = 0
    opened: int | None = None

    def call(self, ts: int, failed: bool) -> tuple[str, bool]:
        """State that the call met, and whether it went through."""
        state = "closed" if self.opened is None else "half-open" if ts - self.opened >= self.cooldown else "open"
        if state == "open":
            return state, False
        if failed:
            self.run += 1
            if state == "half-open" or self.run >= self.failures:
                self.opened = ts
        else:
            self.run, self.opened = 0, None
        return state, True


def circuit_breaker(calls: DataFrame, failures: int = FAILURES, cooldown_ms: int = COOLDOWN_MS) -> DataFrame:
    """Each of calls(key, call_id, ts_ms, failed) with the breaker's state and whether it passed, in order of time (ties: id) within the key."""

    def start():
        b = Breaker(failures, cooldown_ms)
        return lambda _, ts, failed: b.call(ts or 0, bool(failed))

    d = calls.select(*(F.col(c).cast(t).alias(c) for c, t in (("key", "string"), ("call_id", "long"), ("ts_ms", "long"), ("failed", "boolean"))))
    return _in_order(d, start, "key string, call_id long, ts_ms long, failed boolean, state string, passed boolean", 2)


def pool_cost(pool: Column) -> Column:
    """Cost of a call to a pool, 1 at least."""
    return F.coalesce(*[F.when(pool == k, F.lit(v)) for k, v in POOL_COST.items()], F.lit(1))


def role_rank(role: Column) -> Column:
    return F.coalesce(*[F.when(role == r, F.lit(k)) for r, k, *_ in ROLES], F.lit(0))


def visible_tools(users: DataFrame, tools: DataFrame) -> DataFrame:
    """users(user, role) with the tools(tool, pool, min_role) that their role may use; roles include those below. Unknown roles see nothing."""
    known = [r for r, *_ in ROLES]
    having = F.filter(F.array(*map(F.lit, known)), lambda r: role_rank(r) >= role_rank(F.col("min_role")))
    # a tool once for each role that may use it, so users find theirs by an equi-join
    return users.join(tools.where(F.col("min_role").isin(known)).withColumn("role", F.explode(having)), "role").select(*users.columns, *tools.columns)


def redact(attributes: Column, allowed: tuple[str, ...]) -> Column:
    """A map with all keys, and the values of keys that aren't allowed masked."""
    return F.transform_values(attributes, lambda k, v: F.when(k.isin(*allowed), v).otherwise(REDACTED))


QUERY_BYTES, BLOCK = 16 << 20, 4096


def top_k_similar(queries: DataFrame, items: DataFrame, k: int = 5, min_score: float | None = None, query_bytes: int = QUERY_BYTES, block: int = BLOCK) -> DataFrame:
    """query_id, item_id, score, rank: the k items with the greatest cosine (rounded to nine places; ties: the least id), for queries(query_id, vector) and items(item_id, vector).

    Exact, as products of blocks of vectors: each block of items meets all queries and gives its k best, and the best of these are taken. Queries of up to ``query_bytes`` go to the executors once, and items stay where they are; more queries are dealt in blocks too, and every two blocks meet in one task.

    Items with an invalid id (null) or vector are dropped silently, as are zero vectors and those of another length than the query's.
    """

    def unit(df, name):
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        d = df.select(name, F.col("vector").cast("array<double>").alias("vector")).where("vector is not null and not exists(vector, x -> x is null)")
        return d.withColumn("_n", norm).where("_n > 0").select(name, F.transform("vector", lambda x: x / F.col("_n")).alias("vector"))

    q, i = unit(queries.where("query_id is not null"), "query_id"), unit(items.where("item_id is not null"), "item_id")
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, item_id {i.schema['item_id'].dataType.simpleString()}, score double"

    def best(qid: pa.Array, qv: pa.Array, iid: pa.Array, iv: pa.Array):
        """The k best items of a block for each query."""
        if not len(qid) or not len(iid):
            return
        order = pc.sort_indices(iid)
        iid, iv = iid.take(order), iv.take(order)
        ql, il = (np.asarray(pc.list_value_length(v)) for v in (qv, iv))
        for width in np.intersect1d(ql, il):
            a, b = np.flatnonzero(ql == width), np.flatnonzero(il == width)
            matrix = lambda v, at: np.asarray(pc.list_flatten(v.take(pa.array(at)))).reshape(len(at), -1)
            left, right, ids = matrix(qv, a), matrix(iv, b), np.arange(len(b))
            for lo in range(0, len(a), 512):
                score = at = None
                for low in range(0, len(b), block):  # the best so far meet the next items, in the order of ids
                    s = np.round(left[lo : lo + 512] @ right[low : low + block].T, 9) + 0.0
                    n = np.broadcast_to(ids[low : low + block], s.shape)
                    if score is not None:
                        s, n = np.hstack([score, s]), np.hstack([at, n])
                    top = np.argsort(-s, axis=1, kind="stable")[:, :k]  # equal scores keep the order of ids
                    score, at = np.take_along_axis(s, top, 1), np.take_along_axis(n, top, 1)
                row = np.repeat(np.arange(len(score)), score.shape[1])
                flat, found = score.ravel(), at.ravel()
                keep = flat >= min_score if min_score is not None else np.ones(len(flat), bool)
                yield pa.RecordBatch.from_arrays([qid.take(pa.array(a[lo + row[keep]])), iid.take(pa.array(b[found[keep]])), pa.array(flat[keep])], ["query_id", "item_id", "score"])

    size = q.agg(F.sum(F.size("vector") * 8 + 16)).first()[0] or 0
    if size <= query_bytes:
        t = q.toArrow().combine_chunks()
        qid, qv = (t.column(c).combine_chunks() if t.num_rows else pa.array([], t.schema.field(c).type) for c in ("query_id", "vector"))

        def scan(batches):
            for b in batches:
                for lo in range(0, b.num_rows, block):
                    yield from best(qid, qv, b.column("item_id").slice(lo, block), b.column("vector").slice(lo, block))

        d = i.mapInArrow(scan, schema)
    else:
        parts = max(1, -(-size // query_bytes))
        cells = max(1, -(-i.count() // (block * 16)))
        q = q.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(parts))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
        i = i.withColumn("_i", F.pmod(F.xxhash64("item_id"), F.lit(cells))).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            one = lambda t, c: t.column(c).combine_chunks()
            found = list(best(one(left, "query_id"), one(left, "vector"), one(right, "item_id"), one(right, "vector"))) if left.num_rows and right.num_rows else []
            return pa.Table.from_batches(found) if found else pa.table({"query_id": left.column("query_id").slice(0, 0), "item_id": right.column("item_id").slice(0, 0), "score": pa.array([], pa.float64())})

        by = lambda df: df.withColumns({c: F.col(c).cast("long") for c in ("_q", "_i")}).groupBy("_q", "_i")
        d = by(q).cogroup(by(i)).applyInArrow(meet, schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Tool:
    """A named operator: pool, least role, and a callable of keyword arguments."""

    name: str
    pool: str
    run: Callable
    min_role: str = "Reader"
    schema: dict = field(default_factory=dict)

    @property
    def cost(self) -> int:
        return max(1, POOL_COST.get(self.pool, 1))


class Registry:
    """Tools by name. ``dispatch`` never raises: an unknown tool, a role that may not, or an error gives {error, hint}."""

    def __init__(self):
        self._tools: dict[str, Tool] = {}

    def register(self, tool: Tool) -> None:
        if tool.name in self._tools:
            raise ValueError(f"{tool.name} is taken")
        self._tools[tool.name] = tool

    def __iter__(self) -> Iterator[Tool]:
        return iter(sorted(self._tools.values(), key=lambda t: t.name))

    def for_role(self, role: str) -> list[Tool]:
        rank = {r: k for r, k, *_ in ROLES}
        return [t for t in self if rank.get(role, 0) >= rank[t.min_role]]

    def dispatch(self, name: str, role: str, **args) -> dict:
        if name not in self._tools:
            return {"error": f"unknown tool {name}", "hint": "see the list of tools"}
        tool = self._tools[name]
        if tool not in self.for_role(role):
            return {"error": "not allowed", "hint": f"{name} needs the role {tool.min_role}"}
        wanted, known = tool.schema.get("required", ()), tool.schema.get("properties")
        if missing := [x for x in wanted if x not in args]:
            return {"error": f"missing {', '.join(missing)}", "hint": "see the tool's schema"}
        if known is not None and (extra := sorted(set(args) - set(known))):
            return {"error": f"unknown {', '.join(extra)}", "hint": "see the tool's schema"}
        try:
            return {"data": tool.run(**args)}
        except Exception as e:  # noqa: BLE001  the edge answers with a message, whatever went wrong
            return {"error": str(e).splitlines()[0] if str(e) else type(e).__name__, "hint": "check the arguments"}
