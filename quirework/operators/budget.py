"""The budget gate and the usage ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.config import Budget
from quirework.functions.money import cost, effective_limit, output_estimate
from quirework.operators import segments


def decision(config: Budget, tokens_in: Column, tokens_out: Column, used: dict[str, Column], spent: Column | None = None) -> Column:
    """The scope of the first limit that a batch would break, or null if it may go.

    ``used``: requests, run_in, run_out, day_in, day_out, month_in, month_out, and
    cost_run, cost_day, cost_month where ``spent``, the batch's cost, is given.  Reaching a limit is allowed.
    """
    m = config.margin_percent
    out = F.when((tokens_in > config.max_source_tokens_per_request) | (tokens_out > config.max_output_tokens_per_request), "REQUEST")
    out = out.when(used["requests"] + 1 > config.max_requests_per_run, "RUN")
    for scope, most_in, most_out in (("run", config.max_input_per_run, config.max_output_per_run), ("day", config.max_input_per_day, config.max_output_per_day), ("month", config.max_input_per_month, config.max_output_per_month)):
        out = out.when((used[f"{scope}_in"] + tokens_in > effective_limit(most_in, m)) | (used[f"{scope}_out"] + tokens_out > effective_limit(most_out, m)), scope.upper())
    if spent is not None:
        for scope, most in (("run", config.max_cost_per_run), ("day", config.max_cost_per_day), ("month", config.max_cost_per_month)):
            if most is not None:
                out = out.when(F.coalesce(used.get(f"cost_{scope}", F.lit(0.0)), F.lit(0.0)) + spent > most, "COST")
    return out


def requests(sizes: Column, most_in: int, most_out: int) -> Column:
    """The requests that a batch of segments (their tokens) goes out as: (a, z, tokens_in, tokens_out, fits) each, in order.

    A batch over a request limit is halved, the first half the larger, until the parts fit
    or are single segments; only the latter may not fit.  All batches halve level by level, so
    it stays an expression: after as many levels as the size has doublings all parts are single.
    Output is estimated from the input.
    """
    total = lambda p: F.aggregate(F.slice(sizes, p["a"] + 1, p["z"] - p["a"]), F.lit(0).cast("long"), lambda have, x: have + x)
    fits = lambda n: (n <= most_in) & (output_estimate(n) <= most_out)
    span = lambda a, z: F.struct(a.cast("int").alias("a"), z.cast("int").alias("z"))

    def halved(p: Column) -> Column:
        middle = F.ceil((p["a"] + p["z"]) / F.lit(2.0))
        return F.when((p["z"] - p["a"] <= 1) | fits(total(p)), F.array(p)).otherwise(F.array(span(p["a"], middle), span(middle, p["z"])))

    levels = F.array_repeat(F.lit(0), F.ceil(F.log2(F.greatest(F.size(sizes), F.lit(1)))).cast("int"))
    spans = F.aggregate(levels, F.array(span(F.lit(0), F.size(sizes))), lambda have, _: F.flatten(F.transform(have, halved)))

    def told(p: Column) -> Column:
        n = total(p)
        return F.struct(p["a"].alias("a"), p["z"].alias("z"), n.alias("tokens_in"), output_estimate(n).alias("tokens_out"), fits(n).alias("fits"))

    return F.when(F.size(sizes) > 0, F.transform(spans, told)).otherwise(F.array().cast("array<struct<a:int,z:int,tokens_in:bigint,tokens_out:bigint,fits:boolean>>"))


def queue(batches: DataFrame, run: str | list[str], order: str, sizes: str, config: Budget, *, prices: tuple[float, float] | None = None) -> DataFrame:
    """(run..., order, part, a, z, tokens_in, tokens_out, scope, admitted): every request of a run's queue of batches, and what became of it.

    ``sizes`` holds the tokens of a batch's segments, ``order`` its place (an integer) in its
    run.  A request takes segments a to z of its batch.  Halves take the place of a batch
    that is too large, and each of them uses up requests, tokens and cost.  ``scope`` is null
    for what goes out, REQUEST for a single segment that fits no request (it fails and uses up
    nothing), the first broken limit for the request at which the run stops, and
    NOT_REACHED behind it.

    What the ledger held before a run comes in the columns ``day_in``, ``day_out``,
    ``month_in`` and ``month_out`` (0 where a column is absent or null), with ``prices`` also in
    ``cost_day`` and ``cost_month``.

    How a batch is cut depends on the batch alone, and until a run stops everything that fits has gone out.
    So a queue is a running total over requests: of batches in two levels, then within a
    batch's few requests.  No task holds a run.
    """
    run = [run] if isinstance(run, str) else run
    old = [c for c in (f"{s}_{d}" for s in ("day", "month") for d in ("in", "out")) if c in batches.columns] + [c for c in ("cost_day", "cost_month") if c in batches.columns]
    rows = batches.select(*run, order, *old, requests(F.col(sizes), config.max_source_tokens_per_request, config.max_output_tokens_per_request).alias("_parts"))
    good = F.filter("_parts", lambda p: p["fits"])
    added = lambda array, name: F.aggregate(array, F.lit(0).cast("long"), lambda have, p: have + p[name])
    rows = rows.withColumns({"_n": F.size(good).cast("long"), "_i": added(good, "tokens_in"), "_o": added(good, "tokens_out")})
    rows = segments.running(rows, run, order, {"_ahead": "_n", "_ahead_in": "_i", "_ahead_out": "_o"})
    rows = rows.select(*run, order, *old, "_ahead", "_ahead_in", "_ahead_out", "_parts", F.posexplode("_parts").alias("part", "_p"))
    earlier = F.filter(F.slice("_parts", F.lit(1), F.col("part")), lambda p: p["fits"])
    have = {"requests": F.col("_ahead") + F.size(earlier), "in": F.col("_ahead_in") + added(earlier, "tokens_in"), "out": F.col("_ahead_out") + added(earlier, "tokens_out")}
    rows = rows.withColumns({f"_have_{k}": v for k, v in have.items()}).select(*run, order, *old, "part", "_p.a", "_p.z", "_p.tokens_in", "_p.tokens_out", *[f"_have_{k}" for k in have])
    held = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in old else F.lit(0)
    used = {"requests": F.col("_have_requests")} | {f"{s}_{d}": F.col(f"_have_{d}") + (held(f"{s}_{d}") if s != "run" else 0) for s in ("run", "day", "month") for d in ("in", "out")}
    spent = None
    if prices:
        of = lambda a, b: cost(a, b, *map(F.lit, prices))
        used |= {f"cost_{s}": of(F.col("_have_in"), F.col("_have_out")) + (held(f"cost_{s}") if s != "run" else 0) for s in ("run", "day", "month")}
        spent = of(F.col("tokens_in"), F.col("tokens_out"))
    rows = rows.withColumn("scope", decision(config, F.col("tokens_in"), F.col("tokens_out"), used, spent)).select(*run, order, "part", "a", "z", "tokens_in", "tokens_out", "scope")
    denied = F.col("scope").isNotNull() & (F.col("scope") != "REQUEST")
    stops = rows.where(denied).groupBy(*[F.col(r).alias(f"_r_{r}") for r in run]).agg(F.min(F.struct(F.col(order).alias("o"), F.col("part").alias("p"))).alias("_stop"))
    on = F.lit(True)
    for r in run:
        on = on & F.col(r).eqNullSafe(F.col(f"_r_{r}"))
    out = rows.join(stops, on, "left")
    late = F.coalesce(F.struct(F.col(order).alias("o"), F.col("part").alias("p")) > F.col("_stop"), F.lit(False))
    out = out.withColumn("scope", F.when(late, "NOT_REACHED").otherwise(F.col("scope")))
    return out.select(*run, order, "part", "a", "z", "tokens_in", "tokens_out", "scope", F.col("scope").isNull().alias("admitted"))
