"""Readiness, triggers, emission and ranking of strategy results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def readiness(
    *, compatible: Column, configured: Column, facts: Column, historical: Column, live: Column,
    needs_statistics: Column, statistics_as_of: Column, authoritative: Column, observed: Column, max_age: Column,
) -> Column:
    """The first thing that keeps a strategy from running, or READY. Ages and instants are in the same unit."""
    age = observed - statistics_as_of
    return (
        F.when(~compatible, "INCOMPATIBLE_CONTEXT")
        .when(~configured, "MISSING_CONFIGURATION")
        .when(~facts, "MISSING_FACTS")
        .when(~historical, "MISSING_HISTORICAL")
        .when(~live, "MISSING_LIVE_TIMEFRAME")
        .when(needs_statistics & statistics_as_of.isNull(), "SESSION_STATISTICS_MISSING")
        .when(needs_statistics & ~authoritative, "SESSION_STATISTICS_NOT_AUTHORITATIVE")
        .when(needs_statistics & (max_age.isNull() | (age < 0) | (age > max_age)), "SESSION_STATISTICS_STALE")
        .otherwise("READY")
    )


def covers(required: Column, available: Column) -> Column:
    """Whether every required timeframe is available."""
    return F.size(F.array_except(required, available)) == 0


def triggers(contexts: DataFrame) -> DataFrame:
    """contexts (instrument, version, market_state, tick, quote, finalized_ids, historical) plus which triggers fire.

    Changes are against the context before; a first context has no transition.
    """
    order = Window.partitionBy("instrument").orderBy("version")
    was = lambda c: F.lag(c).over(order)
    first = F.row_number().over(order) == 1
    flags = contexts.withColumns({
        "on_context": F.lit(True),
        "on_tick": F.col("tick").isNotNull() & ~F.col("tick").eqNullSafe(was("tick")),
        "on_quote": F.col("quote").isNotNull() & ~F.col("quote").eqNullSafe(was("quote")),
        "on_candle_finalized": F.size(F.array_except("finalized_ids", F.coalesce(was("finalized_ids"), F.array().cast("array<string>")))) > 0,
        "on_session_transition": ~first & ~F.col("market_state").eqNullSafe(was("market_state")),
        "on_historical_ready": F.col("historical") & ~F.coalesce(was("historical"), F.lit(False)),
    })
    return flags


def newer_only(contexts: DataFrame) -> DataFrame:
    """Contexts whose version is above all that arrived before for their instrument."""
    before = Window.partitionBy("instrument").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return contexts.withColumn("__top", F.max("version").over(before)).where("__top is null or version > __top").drop("__top")


def emit(results: DataFrame, policy: str) -> DataFrame:
    """The results that go out, by strategy, instrument and trading date in order of arrival.

    CONTINUOUS: the material key changed. EDGE: the status changed, from NO_MATCH at first. ONE_SHOT: the first MATCHED.
    Only MATCHED and NO_MATCH ever leave.
    """
    order = Window.partitionBy("strategy_id", "instrument", "trading_date").orderBy("arrival")
    able = results.where(F.col("status").isin("MATCHED", "NO_MATCH"))
    if policy == "CONTINUOUS":
        key = F.struct("status", "score", "confidence", "reasons", "metrics")
        held = able.withColumn("__key", key).withColumn("__go", ~F.col("__key").eqNullSafe(F.lag("__key").over(order)) | (F.row_number().over(order) == 1)).drop("__key")
    elif policy == "EDGE":
        held = able.withColumn("__go", F.col("status") != F.lag("status", 1, "NO_MATCH").over(order))
    elif policy == "ONE_SHOT":
        matched = able.where("status = 'MATCHED'")
        held = matched.withColumn("__go", F.row_number().over(order) == 1)
    else:
        raise ValueError(policy)
    return held.where("__go").drop("__go")


def promote(evaluations: DataFrame, strategy_id: str, strategy_version: str, config_version: str, observed: str = "observed_us") -> DataFrame:
    """evaluations with the strategy's names and versions, stamped with the context's instant."""
    return evaluations.withColumns({
        "strategy_id": F.lit(strategy_id), "strategy_version": F.lit(strategy_version), "config_version": F.lit(config_version), "evaluated_us": F.col(observed),
    })


def rank_in_context(results: DataFrame) -> DataFrame:
    """MATCHED results with a score, ranked within instrument and version: score down, then strategy."""
    order = Window.partitionBy("instrument", "version").orderBy(F.desc("score"), "strategy_id")
    return results.where("status = 'MATCHED' and score is not null").withColumn("rank", F.row_number().over(order))


#: Outcomes of a strategy are folded in blocks of so many arrivals, whose sums are then carried on.
BLOCK_ARRIVALS = 1 << 16


def error_lifecycle(outcomes: DataFrame, threshold: int, block: int = BLOCK_ARRIVALS) -> DataFrame:
    """outcomes (strategy_id, arrival, failed) plus failures in a row and whether the strategy is in ERROR by then; a success resets.

    There are few strategies and many outcomes: runs are counted within blocks of arrivals, and what a block
    leaves is carried over the blocks, a row each.
    """
    rows = outcomes.withColumn("__block", F.floor(F.col("arrival") / block).cast("long"))
    inside = Window.partitionBy("strategy_id", "__block").orderBy("arrival")
    run = Window.partitionBy("strategy_id", "__block", "__run").orderBy("arrival")
    rows = rows.withColumn("__run", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(inside))
    rows = rows.withColumn("__own", F.sum(F.col("failed").cast("int")).over(run).cast("long"))
    blocks = rows.groupBy("strategy_id", "__block").agg(
        F.max("__run").alias("successes"), F.max_by("__own", "arrival").alias("tail"),
        F.max(F.when(F.col("__run") == 0, F.col("__own"))).alias("head"), F.max("__own").alias("most"),
    )
    order = Window.partitionBy("strategy_id").orderBy("__block")
    stretch = Window.partitionBy("strategy_id", "__stretch").orderBy("__block")
    blocks = blocks.withColumn("__stretch", F.sum((F.col("successes") > 0).cast("int")).over(order))
    blocks = blocks.withColumn("__left", F.sum("tail").over(stretch)).withColumn("__carry", F.coalesce(F.lag("__left").over(order), F.lit(0)))
    worst = F.greatest(F.col("most"), F.coalesce(F.col("head") + F.col("__carry"), F.lit(0)))
    before = F.coalesce(F.max(worst >= threshold).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    carried = blocks.withColumn("__before", before).select("strategy_id", "__block", "__carry", "__before")
    told = rows.join(carried, ["strategy_id", "__block"]).withColumn("failures", F.col("__own") + F.when(F.col("__run") == 0, F.col("__carry")).otherwise(0))
    told = told.withColumn("in_error", F.col("__before") | F.max(F.col("failures") >= threshold).over(inside))
    return told.drop("__block", "__run", "__own", "__carry", "__before")


def collapse(results: DataFrame, universe: DataFrame, policies: DataFrame) -> DataFrame:
    """What a scanner holds: per strategy its newest trading date, that date's first versions, and an instrument's newest context.

    results: arrival, strategy_id, strategy_version, config_version, instrument, context_version, trading_date, status.
    """
    known = results.where("trading_date is not null and status in ('MATCHED', 'NO_MATCH')")
    known = known.join(policies.select("strategy_id"), "strategy_id", "left_semi").join(universe.select("instrument"), "instrument", "left_semi")
    newest = known.groupBy("strategy_id").agg(F.max("trading_date").alias("trading_date"))
    today = known.join(newest, ["strategy_id", "trading_date"], "left_semi")
    pins = today.groupBy("strategy_id").agg(F.min_by(F.struct("strategy_version", "config_version"), "arrival").alias("pin"))
    pinned = today.join(pins, "strategy_id").where(F.struct("strategy_version", "config_version") == F.col("pin")).drop("pin")
    order = Window.partitionBy("strategy_id", "trading_date", "instrument").orderBy(F.desc("context_version"), "arrival")
    return pinned.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def metric_of(entries: Column, name: str) -> Column:
    """The value of the first entry (name, value) of that name as decimal(38,18); null if there is none or it isn't a number."""
    return F.get(F.filter(entries, lambda x: x["name"] == name), F.lit(0))["value"].try_cast("decimal(38,18)")


def rank_candidates(results: DataFrame, metric: str, descending: bool = False, keys: tuple[str, ...] = ("trading_date",)) -> DataFrame:
    """MATCHED rows with a metric, ranked 1..n by it; ties by exchange and symbol upwards in either direction."""
    by = F.desc(metric) if descending else F.asc(metric)
    order = Window.partitionBy(*keys).orderBy(by, "exchange", "symbol")
    return results.where((F.col("status") == "MATCHED") & F.col(metric).isNotNull()).withColumn("rank", F.row_number().over(order))


def snapshot_header(results: DataFrame, metric: str, universe: DataFrame, keys: tuple[str, ...] = ("trading_date",)) -> DataFrame:
    """expected, evaluated, eligible and completeness of each snapshot: COMPLETE if all of the universe was evaluated."""
    n = universe.select("instrument").distinct().count()
    counted = results.groupBy(*keys).agg(
        F.count("*").alias("evaluated"), F.count_if((F.col("status") == "MATCHED") & F.col(metric).isNotNull()).alias("eligible")
    )
    whole = F.when(F.col("evaluated") == F.col("expected"), "COMPLETE").otherwise("PARTIAL")
    return counted.withColumn("expected", F.lit(n).cast("long")).withColumn("completeness", whole)


def project(ranked: DataFrame, limit: int, metric: str) -> DataFrame:
    """The first limit of each ranking, the metric as exact text; counts live in the header."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1 to 500")
    return ranked.where(F.col("rank") <= limit).withColumn(metric, F.col(metric).cast("string"))


#: Which command leads from which states to which.
TRANSITIONS = {
    "start": (("REGISTERED", "STOPPED", "ERROR"), "STARTING"),
    "mark_running": (("STARTING",), "RUNNING"),
    "pause": (("RUNNING",), "PAUSED"),
    "resume": (("PAUSED",), "RUNNING"),
    "stop": (("RUNNING", "PAUSED", "ERROR"), "STOPPED"),
    "force_stop": (("RUNNING", "PAUSED", "ERROR"), "STOPPED"),
    "mark_error": (("STARTING", "RUNNING"), "ERROR"),
}


def lifecycle(commands: DataFrame, clean_cancellable: str | None = None) -> DataFrame:
    """Each command (strategy_id, arrival, command) with the state it finds, the state it leaves and whether it was allowed.

    A strategy begins REGISTERED. A command that its state doesn't allow changes nothing. A strategy that is STARTING
    is force-stopped only where the column clean_cancellable says that its start can be cancelled cleanly. The fold runs
    over one strategy's commands, which operators give by hand and are few.
    """
    table = F.create_map(*[F.lit(x) for c, (sources, to) in TRANSITIONS.items() for s in sources for x in (f"{s}>{c}", to)], F.lit("STARTING>force_stop_clean"), F.lit("STOPPED"))
    if clean_cancellable:
        clean = (F.col("command") == "force_stop") & F.coalesce(F.col(clean_cancellable), F.lit(False))
        commands = commands.withColumn("command", F.when(clean, "force_stop_clean").otherwise(F.col("command")))
    rows = commands.groupBy("strategy_id").agg(F.sort_array(F.collect_list(F.struct("arrival", "command"))).alias("c"), F.first(table).alias("t"))
    kind = "array<struct<arrival:bigint,command:string,before:string,after:string,allowed:boolean>>"

    def step(done, x):
        before = F.when(F.size(done) == 0, "REGISTERED").otherwise(F.try_element_at(done, F.lit(-1))["after"])
        given = F.regexp_replace(x["command"], "_clean$", "")
        to = F.coalesce(F.try_element_at(F.col("t"), F.concat_ws(">", before, x["command"])), F.try_element_at(F.col("t"), F.concat_ws(">", before, given)))
        row = F.struct(
            x["arrival"].cast("long").alias("arrival"), given.alias("command"), before.alias("before"), F.coalesce(to, before).alias("after"), to.isNotNull().alias("allowed")
        )
        return F.concat(done, F.array(row))

    told = rows.select("strategy_id", F.aggregate("c", F.array().cast(kind), step).alias("h"))
    return told.select("strategy_id", F.inline("h"))
