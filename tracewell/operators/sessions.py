"""Ledgers of sessions: tool calls, edits, interventions, replays, hypotheses, starvation, telemetry, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALLS = "array<struct<type:string,id:string,name:string,tool_use_id:string,size:bigint>>"


def tool_calls(rows: DataFrame, json: str = "json") -> DataFrame:
    """(session, idx, id, name, size): tool calls of messages (session, idx, json) with the size of their results, if there are any.

    json holds {"content": [{"type": "tool_use", id, name} or {"type": "tool_result", tool_use_id, size}]}.  Bad lines give nothing.
    """
    items = rows.select("session", "idx", F.explode(F.from_json(json, f"content {CALLS}")["content"]).alias("c"))
    calls = items.where("c.type = 'tool_use'").select("session", "idx", "c.id", "c.name")
    results = items.where("c.type = 'tool_result'").groupBy("session", F.col("c.tool_use_id").alias("id")).agg(F.max("c.size").alias("size"))
    return calls.join(results, ["session", "id"], "left").select("session", "idx", "id", "name", "size")


def edit_matches(edits: DataFrame, results: DataFrame, least: int = 12) -> DataFrame:
    """(session, idx, seen): edits (session, idx, old) with a line of `least` characters that an earlier result (session, idx, text) holds."""
    lines = F.array_distinct(F.filter(F.transform(F.split("old", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least))
    pieces = edits.select("session", "idx", F.explode(lines).alias("piece"))
    before = results.select("session", F.col("idx").alias("at"), "text")
    hits = pieces.join(before, "session").where("at < idx and instr(text, piece) > 0").groupBy("session", "idx").agg(F.min("at").alias("seen"))
    return edits.select("session", "idx").join(hits, ["session", "idx"], "left")


def outcomes(emitted: DataFrame, found: DataFrame) -> DataFrame:
    """Interventions (id, family, hints, ...) with their outcomes in the order of the ledger (seq), comma-joined; outcomes of unknown
    interventions are left out; `resolution` is the last outcome that is not censored."""
    of = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "outcome"))).alias("o"))
    names = F.transform("o", lambda x: x["outcome"])
    out = emitted.join(of, "id", "left").withColumn("outcomes", F.coalesce(F.array_join(names, ","), F.lit("")))
    last = F.element_at(F.filter(names, lambda x: x != "censored"), -1)
    return out.withColumn("resolution", F.when(F.size(F.filter(names, lambda x: x != "censored")) > 0, last)).drop("o")


def by_family(events: DataFrame) -> DataFrame:
    """(family, n, resolved, open, hinted, hinted_resolved, rate): interventions by family; the rate leaves open ones out."""
    n = lambda t: F.sum(t.cast("long"))
    done = F.col("resolution").isNotNull()
    g = events.groupBy("family").agg(F.count(F.lit(1)).alias("n"), n(done).alias("resolved"), n(~done).alias("open"), n(F.col("hints") > 0).alias("hinted"), n(done & (F.col("hints") > 0)).alias("hinted_resolved"), n(F.col("resolution") == "landing").alias("landed"))
    return g.withColumn("rate", F.when(F.col("resolved") > 0, F.coalesce("landed", F.lit(0)) / F.col("resolved"))).withColumn("landed", F.coalesce("landed", F.lit(0)))


def fetched(picks: DataFrame, fetches: DataFrame) -> DataFrame:
    """Picks (run, at) with how many fetches (run, at) of their run came later."""
    later = picks.select("run", "at").distinct().join(fetches.select("run", F.col("at").alias("f")), "run").where("f > at").groupBy("run", "at").agg(F.count(F.lit(1)).alias("fetches"))
    return picks.join(later, ["run", "at"], "left").withColumn("fetches", F.coalesce("fetches", F.lit(0)))


def downstream(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """(session, idx, fact, first_use): facts (session, idx, fact) with the first later call (session, idx, text) that names them as a word.

    Words of calls are exploded, so that facts meet only the calls that hold them.
    """
    words = calls.select("session", F.col("idx").alias("at"), F.explode(F.array_distinct(F.split("text", "[^\\p{L}\\p{N}_]+"))).alias("fact"))
    use = facts.join(words, ["session", "fact"]).where("at > idx").groupBy("session", "idx", "fact").agg(F.min("at").alias("first_use"))
    return facts.join(use, ["session", "idx", "fact"], "left")


def regret(facts: DataFrame, profile: str) -> DataFrame:
    """(profile, facts, inline, hop, naive, actual, oracle): what a replay cost.  facts (profile, tokens, shown, first_use): naive shows
    all, actual what was shown, oracle only what was used; inline were shown and used, hop had to be fetched."""
    used = F.col("first_use").isNotNull()
    n = lambda t: F.sum(t.cast("long"))
    spent = lambda t: F.coalesce(F.sum(F.when(t, F.col("tokens"))), F.lit(0)).cast("long")
    g = facts.groupBy(profile).agg(F.count(F.lit(1)).alias("facts"), n(used & F.col("shown")).alias("inline"), n(used & ~F.col("shown")).alias("hop"), spent(F.lit(True)).alias("naive"), spent(F.col("shown")).alias("actual"), spent(used).alias("oracle"))
    return g.withColumn("regret", F.col("actual") - F.col("oracle"))


def hypotheses(rows: DataFrame, most: int = 3) -> DataFrame:
    """(session, idx, closed_at, why) of rows (session, idx, kind): a hypothesis ends with the next change of generation (an edit), or
    with the `most`-th command after it, whichever comes first; else it is open."""
    ahead = Window.partitionBy("session").orderBy("idx")
    to_end = ahead.rowsBetween(1, Window.unboundedFollowing)
    runs = F.sum(F.when(F.col("kind") == "command", 1).otherwise(0)).over(ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"_n": runs, "_edit": F.min(F.when(F.col("kind") == "edit", F.col("idx"))).over(to_end)})
    nth = rows.where("kind = 'command'").select("session", F.col("_n").alias("_k"), F.col("idx").alias("_full"))
    h = rows.where("kind = 'hypothesis'").withColumn("_k", F.col("_n") + most).join(nth, ["session", "_k"], "left")
    end = F.least("_edit", "_full")
    return h.select("session", "idx", end.alias("closed_at"), F.when(end.isNull(), "open").when(end == F.col("_edit"), "generation").otherwise("expired").alias("why"))


def starvation(runs: DataFrame) -> DataFrame:
    """(session, idx, verdict) of runs (session, idx, kind, command) but the first: against the run before it, a command is a validation
    if an edit lies between, equivalent (starved) if it is the same, narrowed if it goes on from it, and else other."""
    by = Window.partitionBy("session").orderBy("idx")
    edits = F.sum(F.when(F.col("kind") == "edit", 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    r = runs.withColumn("_g", edits).where("kind <> 'edit'")
    r = r.withColumns({"_c": F.lag("command").over(by), "_pg": F.lag("_g").over(by)}).where("_c is not null")
    verdict = F.when(F.col("_g") > F.col("_pg"), "validation").when(F.col("command") == F.col("_c"), "equivalent").when(F.col("command").startswith(F.concat("_c", F.lit(" "))), "narrowed").otherwise("other")
    return r.select("session", "idx", verdict.alias("verdict"))


def telemetry(rows: DataFrame, by: str) -> DataFrame:
    """(by, calls, raw, emitted, gain): bytes read and passed on, and the tokens that this saved, none if it passed on more."""
    g = rows.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.sum("raw").alias("raw"), F.sum("emitted").alias("emitted"))
    return g.withColumn("gain", F.greatest(F.lit(0), F.floor((F.col("raw") - F.col("emitted")) / 4)).cast("long"))


def compared(plain: DataFrame, wrapped: DataFrame) -> DataFrame:
    """(identity, tokens, with_tokens, saved): sessions (identity, tokens, accepted, complete) of two arms; a saving counts only where both
    were accepted and are complete."""
    b = wrapped.select("identity", F.col("tokens").alias("with_tokens"), F.col("accepted").alias("_a"), F.col("complete").alias("_c"))
    ok = F.col("accepted") & F.col("_a") & F.col("complete") & F.col("_c")
    return plain.join(b, "identity").select("identity", "tokens", "with_tokens", F.when(ok, F.col("tokens") - F.col("with_tokens")).alias("saved"))


def signature(command: Column) -> Column:
    """A command without its arguments: the program's base name, and its first word that is no flag or path."""
    words = F.split(F.trim(command), "[ \\t]+")
    head = F.regexp_replace(F.element_at(words, 1), "^.*/", "")
    sub = F.element_at(F.filter(F.slice(words, 2, F.size(words)), lambda w: w.rlike("^[A-Za-z][A-Za-z0-9_-]*$")), 1)
    return F.concat_ws(" ", head, F.when(F.size(F.filter(F.slice(words, 2, F.size(words)), lambda w: w.rlike("^[A-Za-z][A-Za-z0-9_-]*$"))) > 0, sub))


def canonical_json(json: Column) -> Column:
    """A flat JSON object with sorted keys and no spaces."""
    m = F.from_json(json, "map<string,string>")
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
