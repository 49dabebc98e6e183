"""Ledgers: usage and cost, scorecards, follow-up windows, policies, relays, tasks.  Missing values stay missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import strict_sum, wilson_low

USAGE = ("input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens")


def normalised(usage: DataFrame) -> DataFrame:
    """Disjoint token classes: where a provider counts cached tokens as input, they are taken out of it."""
    inside = F.col("provider") == "inclusive"
    uncached = F.when(inside, F.greatest(F.col("input_tokens") - F.col("cache_read_tokens"), F.lit(0))).otherwise(F.col("input_tokens"))
    return usage.withColumn("uncached_tokens", uncached)


def usage_summary(usage: DataFrame, by: str) -> DataFrame:
    """Totals that are null unless every row has a value, and a status."""
    known = F.count("input_tokens")
    total = F.count(F.lit(1))
    status = F.when(known == total, "available").when(known > 0, "partial").otherwise("unavailable")
    basis = F.when(F.countDistinct("provider") == 1, F.min("provider")).otherwise("mixed")
    return usage.groupBy(by).agg(total.alias("responses"), strict_sum(F.col("input_tokens")).alias("input_tokens"), strict_sum(F.col("output_tokens")).alias("output_tokens"), status.alias("status"), basis.alias("basis"))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Each model with the first price row, by priority, whose match is a part of its name between non-letters.

    The distinct models are few and meet the small price table once; usage joins the result by an equi-join.
    """
    models = usage.select("model").distinct()
    fits = F.expr("concat('-', model, '-') rlike concat('[^a-z]', match, '[^a-z]')")
    tries = models.join(F.broadcast(prices), fits)  # a shipped table of some hundred rows
    best = tries.groupBy("model").agg(F.min_by(F.struct("match", "in_rate", "out_rate"), "priority").alias("p"))
    return usage.join(best, "model", "left")


def economics(usage: DataFrame, prices: DataFrame, by: str) -> DataFrame:
    """Cost of each group: reported cost, else tokens by rate; null unless every response has one."""
    rows = priced(usage, prices)
    made = (F.col("input_tokens") * F.col("p.in_rate") + F.col("output_tokens") * F.col("p.out_rate")) / 1e6
    rows = rows.withColumn("cost", F.coalesce("cost_usd", made))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("responses"), strict_sum(F.col("cost")).alias("cost"), F.count("cost").alias("priced"), (F.count("cost") == F.count(F.lit(1))).alias("complete"))


def invalidations(wire: DataFrame, thread: str, order: list[str]) -> DataFrame:
    """Requests whose cache read is below the greatest one before in their thread."""
    by = Window.partitionBy(thread).orderBy(*order)
    top = F.max("read").over(by.rowsBetween(Window.unboundedPreceding, -1))
    return wire.withColumn("best", top).withColumn("dropped", F.coalesce(F.col("read") < F.col("best"), F.lit(False)))


def followup(emissions: DataFrame, actions: DataFrame, most_actions: int = 6, most_generations: int = 2) -> DataFrame:
    """What happened in the window after each emission: its next actions of the session, until it closes.

    emissions (session, idx, signature, needle), actions (session, idx, kind, command, signature).  An action counts a
    generation if it edits.  The window closes with the action that fills it or exceeds the generations.  The join is
    on the session and the action's place, so an emission meets at most `most_actions` rows.
    """
    by = Window.partitionBy("session").orderBy("idx")
    acts = actions.withColumn("k", F.row_number().over(by))
    marks = emissions.select("session", "idx", F.lit(None).cast("int").alias("k")).unionByName(acts.select("session", "idx", "k"))
    # the number of actions up to each emission; an action of the same index comes first
    before = Window.partitionBy("session").orderBy("idx", F.col("k").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = marks.withColumn("n", F.coalesce(F.max("k").over(before), F.lit(0))).where("k is null").select("session", "idx", "n")
    em = emissions.join(seen, ["session", "idx"])
    want = em.withColumn("k", F.explode(F.sequence(F.col("n") + 1, F.col("n") + most_actions)))
    a = acts.select("session", "k", F.col("kind").alias("a_kind"), F.col("command").alias("a_command"), F.col("signature").alias("a_signature"))
    rows = want.join(a, ["session", "k"], "left")
    w = Window.partitionBy("session", "idx").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edit = F.col("a_kind").isin("edit", "write")
    rows = rows.withColumn("gens", F.sum(F.when(edit, 1).otherwise(0)).over(w))
    rows = rows.withColumn("live", F.col("a_kind").isNotNull() & (F.col("gens") - F.when(edit, 1).otherwise(0) <= most_generations))
    hit = F.col("live") & F.col("a_kind").isin("bash", "retrieval")
    out = rows.groupBy("session", "idx").agg(
        F.sum(F.col("live").cast("long")).alias("actions"),
        F.coalesce(F.max(F.when(F.col("live"), F.col("gens"))), F.lit(0)).cast("long").alias("generations"),
        F.coalesce(F.max(hit & F.expr("instr(a_command, needle) > 0")), F.lit(False)).alias("used"),
        F.coalesce(F.max(hit & (F.col("a_signature") == F.col("signature")) & (F.col("gens") == 0)), F.lit(False)).alias("requery"),
    )
    closed = (F.col("actions") >= most_actions) | (F.col("generations") > most_generations)
    return out.withColumn("censored", ~closed)


def policy(runs: DataFrame, cap: int) -> DataFrame:
    """(signature, n, top, p95, verdict): nearest-rank p95; demoted above 4 caps, promoted with 5 runs within one."""
    g = runs.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("top"), F.expr("percentile_disc(0.95) within group (order by bytes)").cast("long").alias("p95"))
    verdict = F.when(F.col("top") > 4 * cap, "demote").when((F.col("n") >= 5) & (F.col("p95") <= cap), "promote").otherwise("keep")
    return g.withColumn("verdict", verdict)


def rollup(events: DataFrame, by: str, value: str) -> DataFrame:
    """A row for each operator and one for all (*): events counted once by id, with the lower median."""
    once = events.dropDuplicates(["event_id"])
    g = once.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("median"), F.grouping(by).alias("_all"))
    return g.select(F.when(F.col("_all") == 1, "*").otherwise(F.col(by)).alias("operator"), "n", "median")


def density(events: DataFrame, key: str) -> DataFrame:
    """Keys with two starvations or more and fewer landings."""
    n = lambda e: F.sum((F.col("event") == e).cast("long"))
    g = events.groupBy(key).agg(n("starvation").alias("starvations"), n("landing").alias("landings"))
    return g.withColumn("dense", (F.col("starvations") >= 2) & (F.col("landings") < F.col("starvations")))


def ranked_plans(events: DataFrame, by: str, used: Column) -> DataFrame:
    """(by, n, used, low): how surely a plan's evidence is used."""
    g = events.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(used.cast("long")).alias("used"))
    return g.withColumn("low", wilson_low(F.col("used"), F.col("n")))


def labelled_runs(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """Runs with their latest label."""
    last = labels.groupBy("run_id").agg(F.max_by("label", F.struct("ts", "label")).alias("label"))
    return runs.join(last, "run_id")


def observed(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, bytes and the newest time by key."""
    return calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum("bytes").alias("bytes"), F.max("ts").alias("newest"))


def ladder(values: DataFrame, rung: Column, rungs: list[str]) -> DataFrame:
    """(rung, n) for every rung, those without rows included."""
    every = values.sparkSession.createDataFrame([(r,) for r in rungs], "rung string")
    n = values.groupBy(rung.alias("rung")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "rung", "left").select("rung", F.coalesce("n", F.lit(0)).alias("n"))


def task_fold(rows: DataFrame) -> DataFrame:
    """The latest state of each node: attempts, last reason, turns, and cost if every row has one."""
    return rows.groupBy("node").agg(
        F.max("attempt").alias("attempt"), F.max_by("reason", F.struct("seq")).alias("reason"), F.sum("turns").alias("turns"),
        strict_sum(F.col("cost")).alias("cost"), (F.count("cost") == F.count(F.lit(1))).alias("complete"),
    )


def pending(signals: DataFrame, receipts: DataFrame, subscribers: DataFrame, now: Column, cap: int = 32) -> DataFrame:
    """Signals a subscriber has not received, alive, at most `cap` of each: interrupts first, then the oldest.

    A signal to * is due to each subscriber by itself.  A subscriber with k receipts of such signals needs only the first
    cap + k of them, so these are met by their rank: an equi-join, and not all signals with all subscribers.
    """
    first = (F.when(F.col("kind") == "interrupt", 0).otherwise(1), F.col("ts"), F.col("signal_id"))
    alive = signals.where(F.col("expires_at") > now)
    direct = alive.where("addressee <> '*'").withColumn("subscriber", F.col("addressee"))
    got = receipts.select("signal_id", "subscriber").distinct()
    wide = alive.where("addressee = '*'")
    known = got.join(wide.select("signal_id"), "signal_id", "left_semi").groupBy("subscriber").agg(F.count(F.lit(1)).alias("k"))
    want = subscribers.select("subscriber").distinct().join(known, "subscriber", "left").withColumn("k", F.coalesce("k", F.lit(0)) + cap)
    most = want.agg(F.max("k")).first()[0] or 0
    ranked = wide.orderBy(*first).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*first)))  # of `most` rows
    wide = want.select("subscriber", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("rank")).join(ranked, "rank").drop("rank")
    due = direct.unionByName(wide.select(*direct.columns)).join(got, ["signal_id", "subscriber"], "left_anti")
    by = Window.partitionBy("subscriber").orderBy(*first)
    return due.withColumn("place", F.row_number().over(by)).where(F.col("place") <= cap)


def open_debts(rows: DataFrame) -> DataFrame:
    """Debts added and not resolved since: the newest row of a key decides."""
    return rows.groupBy("key").agg(F.max_by("op", F.struct("seq")).alias("op"), F.max("seq").alias("seq")).where("op = 'add'").select("key", "seq")


def fan_out(publish: DataFrame, watches: DataFrame) -> DataFrame:
    """(signal_id, subscriber, kind): watches of the topic whose selector begins the published one, once each.

    Prefixes of the published selector are exploded, so this is an equi-join.
    """
    heads = publish.withColumn("head", F.explode(F.transform(F.sequence(F.lit(0), F.length("selector")), lambda i: F.substr(F.col("selector"), F.lit(1), i))))
    w = watches.select("topic", F.col("selector").alias("head"), "subscriber").distinct()
    return heads.join(w, ["topic", "head"]).select("signal_id", "subscriber", "kind").distinct()
