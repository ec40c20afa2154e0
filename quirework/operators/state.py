"""State as an event log: allowed moves, latest state, leases, settlements."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.operators import segments
from quirework.schemas import TRANSITIONS


def allowed(before: Column, after: Column) -> Column:
    """Is this a move of the state machine; false for states without moves."""
    moves = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(F.try_element_at(moves, before), after), F.lit(False))


def latest(events: DataFrame, key: str, value: Column, order: Column) -> DataFrame:
    """The last value of each key; a partial maximum, so hot keys cost a row a task."""
    return events.groupBy(key).agg(F.max_by(value, order).alias("value"), F.count(F.lit(1)).alias("events"))


def leases(attempts: DataFrame, key: str, holder: str, at: str, order: str, minutes: int = 30) -> DataFrame:
    """(order, key, holder, at, granted, held_by): who gets a key's lock, attempt by attempt.

    A lock goes to whoever asks when it is free, run out, or their own; a refused attempt
    changes nothing.  So every attempt depends on all before it: a fold over the sorted
    attempts of a key, of which a task holds one state at a time.
    """
    kinds = {f.name: f.dataType.simpleString() for f in attempts.schema}
    rows = attempts.select(key, F.col(at), F.col(order), holder).repartition(key).sortWithinPartitions(key, at, order)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, who, until, lease = object(), None, None, pd.Timedelta(minutes=minutes)
        for frame in frames:
            granted, held = [], []
            for k, t, _, h in frame.itertuples(index=False, name=None):
                if k != now:
                    now, who, until = k, None, None
                good = until is None or until <= t or who == h
                if good:
                    who, until = h, t + lease
                granted.append(good)
                held.append(who)
            yield frame.assign(granted=granted, held_by=held)

    return rows.mapInPandas(fold, f"`{key}` {kinds[key]}, `{at}` {kinds[at]}, `{order}` {kinds[order]}, `{holder}` {kinds[holder]}, granted boolean, held_by {kinds[holder]}")


#: States by number; 0 is a job that does not exist yet.
STATES = (*TRANSITIONS, "COMPLETED", "FAILED", "CANCELLED")


def moved(state: int, to: int) -> int | None:
    """The state after a move, or None if it is refused: the first move creates a job, an unknown state is never reached."""
    if not to or (state and STATES[to - 1] not in TRANSITIONS.get(STATES[state - 1], ())):
        return None
    return to


def number(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, s in enumerate(STATES) for x in (F.lit(s), F.lit(k + 1))]), status), F.lit(0))


def applied(moves: DataFrame, key: str, order: str, to: str) -> DataFrame:
    """Adds ``before`` and ``error``: a move that the state machine does not list is INVALID_JOB_TRANSITION and changes nothing.

    So a move's verdict depends on all moves before it.  A stretch of moves is a function
    from states to states, and functions of a dozen states compose: each bucket of a key (by an integer order)
    gives its function, the functions of a key's buckets are folded into the state in which each bucket begins, and the moves
    of a bucket are judged from there.  A key with a third of all moves is dealt over many tasks, all in the JVM.  Moves
    with one order are taken by the state they ask for.
    """
    codes = range(len(STATES) + 1)
    table = F.array(*[F.array(*[F.lit(s if (x := moved(s, k)) is None else x) for k in codes]) for s in codes])
    step = lambda s, k: F.get(F.get(table, s), k)
    less = lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1).otherwise(0)
    one = F.struct(F.col(order).alias("o"), number(F.col(to)).alias("k"), F.struct(*[F.col(c) for c in moves.columns]).alias("row"))
    buckets = moves.groupBy(F.col(key).alias("_key"), F.floor(F.col(order) / segments.BUCKET).alias("_b")).agg(F.array_sort(F.collect_list(one), less).alias("_m"))
    whole = F.aggregate("_m", F.array(*map(F.lit, codes)), lambda have, x: F.transform(have, lambda s: step(s, x["k"])))
    keys = buckets.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct(F.col("_b").alias("b"), whole.alias("f")))).alias("_fs"))
    zero = F.struct(F.lit(0).alias("s"), F.array().cast("array<struct<b:bigint,s:int>>").alias("out"))
    begin = F.aggregate("_fs", zero, lambda have, x: F.struct(F.get(x["f"], have["s"]).alias("s"), F.array_append(have["out"], F.struct(x["b"].alias("b"), have["s"].alias("s"))).alias("out")), lambda have: have["out"])
    begin = keys.select(F.col("_key").alias("_k2"), F.explode(begin).alias("x")).select("_k2", F.col("x.b").alias("_b2"), F.col("x.s").alias("_s"))
    rows = buckets.join(begin, F.col("_key").eqNullSafe(F.col("_k2")) & F.col("_b").eqNullSafe(F.col("_b2")))
    start = F.struct(F.col("_s").alias("s"), F.array().cast("array<int>").alias("out"))
    before = F.aggregate("_m", start, lambda have, x: F.struct(step(have["s"], x["k"]).alias("s"), F.array_append(have["out"], have["s"]).alias("out")), lambda have: have["out"])
    rows = rows.select(F.explode(F.arrays_zip("_m", before.alias("_before"))).alias("x")).select("x._m.row.*", F.col("x._before").alias("_s"), F.col("x._m.k").alias("_k"))
    names = F.array(*map(F.lit, STATES))
    refused = (F.col("_k") == 0) | ((F.col("_s") > 0) & ~F.coalesce(allowed(F.get(names, F.col("_s") - 1), F.get(names, F.col("_k") - 1)), F.lit(False)))
    return rows.select(*moves.columns, F.get(names, F.col("_s") - 1).alias("before"), F.when(refused, "INVALID_JOB_TRANSITION").alias("error"))


def jobs(judged: DataFrame, key: str, order: str, to: str, message: str, at: str) -> DataFrame:
    """(key, status, error_message, created_at, updated_at, last_run_at, refused) of moves that ``applied`` has judged.

    A message stays until another takes its place; entering TRANSLATING is a run.
    """
    ok = F.col("error").isNull()
    last = lambda value, when: F.max_by(value, F.when(when, F.col(order)))
    return judged.groupBy(key).agg(
        last(F.col(to), ok).alias("status"), last(F.col(message), ok & F.col(message).isNotNull()).alias("error_message"), F.min(F.when(ok, F.col(at))).alias("created_at"), F.max(F.when(ok, F.col(at))).alias("updated_at"),
        F.max(F.when(ok & (F.col(to) == "TRANSLATING"), F.col(at))).alias("last_run_at"), F.count_if(~ok).alias("refused"),
    )


def segment_states(log: DataFrame, key: str, order: Column, status: Column, error: Column) -> DataFrame:
    """(key, status, retry_count, error_message) from a log of marks: the last one counts, every failure is a retry."""
    last = F.max_by(F.struct(status.alias("s"), F.when(status == "FAILED", error).alias("e")), order)
    return log.groupBy(key).agg(last.alias("l"), F.count_if(status == "FAILED").alias("retry_count")).select(key, F.col("l.s").alias("status"), "retry_count", F.col("l.e").alias("error_message"))


def stalled(cycles: DataFrame, key: str, order: str, pending: str, repeats: int = 3, most: int = 200) -> DataFrame:
    """(key, cycle, stalled): where a run gives up: its pending count stays for ``repeats`` cycles in a row, or the cycles end."""
    w = Window.partitionBy(key).orderBy(order)
    rows = cycles.withColumn("_c", F.row_number().over(w)).where(F.col("_c") <= most)
    rows = rows.withColumn("_new", F.when(F.lag(pending).over(w).eqNullSafe(F.col(pending)), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_same", F.row_number().over(Window.partitionBy(key, "_run").orderBy(order)) - 1)
    stop = F.min(F.when(F.col("_same") >= repeats, F.col("_c")))
    return rows.groupBy(key).agg(F.coalesce(stop, F.max("_c")).cast("long").alias("cycle"), stop.isNotNull().alias("stalled"))


def settled(sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """(order_id, session_id, payment): orders that sessions (session_id, reference, paid, payment) turn into paid ones.

    A session names its order, or else is known by the order's stored session; only an
    order (order_id, session_id, status) that awaits payment settles, and it does so once.
    """
    by_name = orders.select(F.col("order_id").alias("_o"), F.col("status").alias("_s"))
    by_session = orders.where("session_id is not null").select(F.col("order_id").alias("_o2"), F.col("status").alias("_s2"), F.col("session_id").alias("_session"))
    found = sessions.where("paid").join(by_name, F.col("reference") == F.col("_o"), "left")
    found = found.join(by_session, F.col("reference").isNull() & (F.col("session_id") == F.col("_session")), "left")
    found = found.select(F.coalesce("_o", "_o2").alias("order_id"), F.coalesce("_s", "_s2").alias("status"), "session_id", "payment").where("status = 'AWAITING_PAYMENT'")
    return found.groupBy("order_id").agg(F.min(F.struct("session_id", "payment")).alias("x")).select("order_id", "x.session_id", "x.payment")

