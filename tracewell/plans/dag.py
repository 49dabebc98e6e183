"""Plans: a checked DAG of pipeline steps with guards, bounded fan-out, prices and typed skips.

A plan is {version, question, steps: [{id, op, args, input, foreach, cap, when, after, on_error, on_missing}]}.  It is
validated as a whole, with all problems at once, before a DataFrame is made; steps then run in order on the driver, each
a lazy plan; only guards and fan-out values need an action.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ..operators import combine
from .frame import TERMINAL, EvidenceFrame
from .pipeline import Context, PipelineError
from .registry import COST_UNITS, STAGES

VERSION = "plan/v1"
# Ceilings and the closed list of reasons.
MOST_NODES, MOST_FANOUT = 24, 64
REASONS = (
    "bad_schema", "bad_objective", "bad_budget", "bad_id", "duplicate_id", "unknown_op", "forward_reference",
    "input_required", "source_takes_no_input", "kind_mismatch", "node_budget_exceeded", "fanout_uncapped",
    "fanout_cap_exceeded", "guard_grammar", "bad_args", "bad_on_error", "bad_on_missing", "execute_on_observe_tier",
    "engine_unavailable", "bad_requires",
)
GUARD = re.compile(r"([a-z][a-z0-9_]{0,31})\.(?:count (==|!=|<=|>=|<|>) (\d+)|outcome (==|!=) (pass|fail))")
DIMENSIONS = ("locate", "cause", "change", "test", "usage")


@dataclass(frozen=True)
class Rejection:
    reason: str
    step: str | None
    detail: str


@dataclass
class Result:
    frames: dict[str, EvidenceFrame] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


def validate(plan: dict, tier: str = "full", stages=None) -> list[Rejection]:
    """All that is wrong with a plan; nothing runs."""
    stages = STAGES if stages is None else stages
    out: list[Rejection] = []
    no = lambda reason, step, detail: out.append(Rejection(reason, step, detail))
    if plan.get("version") != VERSION:
        no("bad_schema", None, f"version is {plan.get('version')!r}, not {VERSION!r}")
    if not str(plan.get("question") or "").strip():
        no("bad_objective", None, "no question")
    budget = plan.get("budget") or {}
    if not isinstance(budget, dict) or any(not isinstance(v, (int, float)) or isinstance(v, bool) or v <= 0 for v in budget.values()):
        no("bad_budget", None, "budgets are positive numbers")
        budget = {}
    for r in plan.get("requires") or ():
        if not isinstance(r, dict) or r.get("dimension") not in DIMENSIONS:
            no("bad_requires", None, f"{r} names none of {', '.join(DIMENSIONS)}")
    steps = plan.get("steps") or []
    nodes = min(MOST_NODES, int(budget.get("nodes", MOST_NODES)))
    if not steps or len(steps) > nodes:
        no("node_budget_exceeded", None, f"{len(steps)} steps; 1 to {nodes} are allowed")
    kinds: dict[str, str | None] = {}
    for s in steps:
        sid = str(s.get("id"))
        if not re.fullmatch(r"[a-z][a-z0-9_]{0,31}", sid):
            no("bad_id", sid, "ids are lower-case names of up to 32 characters")
        if sid in kinds:
            no("duplicate_id", sid, "used before")
        stage = stages.get(s.get("op"))
        if stage is None:
            no("unknown_op", sid, f"no operator {s.get('op')!r}")
        for name in [s.get("input"), (s.get("foreach") or "").split(".")[0] or None, *(s.get("after") or ())]:
            if name is not None and name not in kinds:
                no("forward_reference", sid, f"{name!r} is no earlier step")
        if stage is not None:
            if stage.is_source and s.get("input"):
                no("source_takes_no_input", sid, f"{stage.name} reads by itself")
            if not stage.is_source and not s.get("input"):
                no("input_required", sid, f"{stage.name} needs input")
            kind = kinds.get(s.get("input"))
            if not stage.is_source and kind and (kind == TERMINAL or kind not in stage.takes):
                no("kind_mismatch", sid, f"{stage.name} does not take {kind}")
            if tier == "observe" and not stage.observes:
                no("execute_on_observe_tier", sid, f"{stage.name} does more than observe")
        if s.get("foreach"):
            cap = s.get("cap")
            if not isinstance(cap, int) or isinstance(cap, bool) or cap < 1:
                no("fanout_uncapped", sid, "foreach needs a cap")
            elif cap > MOST_FANOUT:
                no("fanout_cap_exceeded", sid, f"a cap of {cap}; {MOST_FANOUT} is the most")
        if s.get("when") is not None:
            m = GUARD.fullmatch(str(s["when"]))
            if not m or m[1] not in kinds:
                no("guard_grammar", sid, "a guard is <earlier step>.count <op> <number> or .outcome == pass")
        if not all(isinstance(a, str) for a in s.get("args") or ()):
            no("bad_args", sid, "arguments are strings")
        if s.get("on_error", "skip_dependents") not in ("skip_dependents", "fail"):
            no("bad_on_error", sid, str(s["on_error"]))
        if s.get("on_missing", "degrade") not in ("degrade", "skip", "fail"):
            no("bad_on_missing", sid, str(s["on_missing"]))
        kinds[sid] = None if stage is None else stage.gives or kinds.get(s.get("input"))
    return out


def price(plan: dict) -> int:
    """Units of a plan before it runs: the cost class of each step times its fan-out."""
    return sum(COST_UNITS[STAGES[s["op"]].cost] * (s.get("cap") or 1 if s.get("foreach") else 1) for s in plan["steps"])


def holds(guard: str, result: Result) -> bool | None:
    """Does a guard hold?  None: it cannot be decided, since its step was skipped."""
    m = GUARD.fullmatch(guard)
    frame = result.frames.get(m[1])
    if frame is None:
        return None
    if m[4]:
        return (frame.df.isEmpty() == (m[5] == "fail")) == (m[4] == "==")
    n, k = frame.df.count(), int(m[3])
    return {"==": n == k, "!=": n != k, "<": n < k, ">": n > k, "<=": n <= k, ">=": n >= k}[m[2]]


def execute(context: Context, plan: dict) -> Result:
    problems = validate(plan)
    if problems:
        raise PipelineError("; ".join(f"{p.reason} {p.step or ''} {p.detail}" for p in problems))
    result = Result()
    for s in plan["steps"]:
        sid, needs = s["id"], [x for x in (s.get("input"), *(s.get("after") or ())) if x]
        if s.get("foreach"):
            needs.append(s["foreach"].split(".")[0])
        if any(n in result.skipped for n in needs):
            result.skipped[sid] = "upstream_skipped"
            continue
        if s.get("when"):
            decided = holds(s["when"], result)
            if not decided:
                result.skipped[sid] = "guard_undecidable" if decided is None else "guard_false"
                continue
        try:
            result.frames[sid] = _step(context, s, result)
        except (PipelineError, ValueError, PySparkException) as e:  # of the engine; anything else is a fault of the code
            if s.get("on_error") == "fail":
                raise
            result.skipped[sid], result.errors[sid] = "error", str(e)
    return result


def _step(context: Context, s: dict, result: Result) -> EvidenceFrame:
    stage, args = STAGES[s["op"]], list(s.get("args") or ())
    source = result.frames.get(s.get("input"))
    if not s.get("foreach"):
        return stage.run(context, source, args)
    step, _, name = s["foreach"].partition(".")
    of = result.frames[step]
    values = combine.first_wins(of.df.select(F.col(name).cast("string").alias("v"), *[o.alias(f"_o{i}") for i, o in enumerate(of.order)]), ["v"], [F.col(f"_o{i}") for i in range(len(of.order))] or [F.col("v")])
    total = values.agg(F.greatest(F.count(F.lit(1)) - s["cap"], F.lit(0)).alias("n"))
    values = [r["v"] for r in values.orderBy(*[f"_o{i}" for i in range(len(of.order))], "v").limit(s["cap"]).collect()]  # the cap is at most 64
    frames = [(v, stage.run(context, source, [a.replace("{item}", v) for a in args])) for v in values]
    out = None
    for v, f in frames:
        df = f.df.withColumn("item", F.lit(v))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise PipelineError("foreach over nothing")
    return EvidenceFrame(out, frames[0][1].kind, (F.col("item"), *frames[0][1].order), omitted=(total, *(o for _, f in frames for o in f.omitted)))


# Frozen templates of plans by intent; {0} is what the question is about.
INTENTS: dict[str, list[dict]] = {
    "locate": [{"id": "hits", "op": "search", "args": ["{0}"]}, {"id": "files", "op": "files", "input": "hits"}],
    "impact": [{"id": "reach", "op": "impact", "args": ["{0}"]}],
    "trace": [{"id": "callers", "op": "callers", "args": ["{0}"]}, {"id": "callees", "op": "callees", "args": ["{0}"], "after": ["callers"]}],
    "diagnose": [
        {"id": "fails", "op": "fails", "args": ["{0}"]},
        {"id": "touched", "op": "in-changed", "input": "fails", "when": "fails.count > 0"},
        {"id": "shared", "op": "shared-cause", "input": "fails"},
    ],
    "compare": [{"id": "before", "op": "fails", "args": ["{0}"]}, {"id": "after", "op": "fails", "args": ["last"], "after": ["before"]}],
    "verify": [{"id": "fails", "op": "fails", "args": ["last"]}, {"id": "left", "op": "in-changed", "input": "fails", "args": ["{0}"], "when": "fails.outcome == pass"}],
    "review": [{"id": "fails", "op": "fails"}, {"id": "changed", "op": "in-changed", "input": "fails"}, {"id": "files", "op": "files", "input": "changed"}],
}


def ask(intent: str, about: str) -> dict:
    steps = [{**s, "args": [a.format(about) for a in s.get("args", [])]} for s in INTENTS[intent]]
    return {"version": VERSION, "question": f"{intent}: {about}", "steps": steps}
