"""Count-bounded observation windows on a stream: the streaming twin of `operators.ledgers.followup`.

A window opens with an emission, sees the next actions of its session, and closes with the one that fills it or exceeds
its generations.  State holds the open windows of a session; each lasts `MOST_ACTIONS` actions at most.  Windows that are
still open when the stream ends are censored: they give no row here.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST_ACTIONS, MOST_GENERATIONS = 6, 2
CLOSED = "session long, idx long, actions long, generations long, used boolean, requery boolean"


def turns(emissions: DataFrame, actions: DataFrame) -> DataFrame:
    """Emissions (session, idx, signature, needle) and actions (session, idx, kind, command, signature) as one stream."""
    none = F.lit(None).cast("string")
    a = actions.select("session", "idx", F.lit(0).alias("side"), "kind", "command", "signature", none.alias("needle"))
    return a.unionByName(emissions.select("session", "idx", F.lit(1).alias("side"), none.alias("kind"), none.alias("command"), "signature", "needle"))


def advance(windows: list[dict], rows: Iterable[tuple]) -> Iterator[tuple]:
    """Rows (idx, side, kind, command, signature, needle) in order: an action meets the open windows, an emission opens one."""
    for idx, side, kind, command, signature, needle in rows:
        if side:
            windows.append({"idx": int(idx), "signature": signature, "needle": needle, "actions": 0, "gens": 0, "used": False, "requery": False})
            continue
        edit = kind in ("edit", "write")
        for w in windows:
            w["actions"] += 1
            w["gens"] += edit
            if kind in ("bash", "retrieval"):
                w["used"] |= w["needle"] in command
                w["requery"] |= signature == w["signature"] and not w["gens"]
        for w in [w for w in windows if w["actions"] >= MOST_ACTIONS or w["gens"] > MOST_GENERATIONS]:
            windows.remove(w)
            yield w["idx"], w["actions"], w["gens"], w["used"], w["requery"]


def followup_stream(stream: DataFrame) -> DataFrame:
    """Closed windows of a stream of `turns`, whose rows of a session come in the order of idx."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        windows = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["idx", "side"], kind="stable")
        out = [(key[0], *w) for w in advance(windows, rows[["idx", "side", "kind", "command", "signature", "needle"]].itertuples(index=False, name=None))]
        state.update((json.dumps(windows),))
        yield pd.DataFrame(out, columns=["session", "idx", "actions", "generations", "used", "requery"])

    return stream.groupBy("session").applyInPandasWithState(run, CLOSED, "windows string", "append", GroupStateTimeout.NoTimeout)


MOST_COMMANDS = 3
ENDED = "session long, idx long, closed_at long, why string"


def hypothesis_stream(stream: DataFrame, most: int = MOST_COMMANDS) -> DataFrame:
    """The streaming twin of `operators.sessions.hypotheses` for rows (session, idx, kind), in the order of idx: hypotheses that end.

    State holds a session's open hypotheses, each for `most` commands at most.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = json.loads(state.get[0]) if state.exists else [], []
        for idx, kind in pd.concat(list(batches)).sort_values("idx")[["idx", "kind"]].itertuples(index=False, name=None):
            if kind == "hypothesis":
                held.append([int(idx), 0])
                continue
            for h in held:
                h[1] += kind == "command"
            gone = held if kind == "edit" else [h for h in held if h[1] >= most]
            out += [(key[0], h[0], int(idx), "generation" if kind == "edit" else "expired") for h in gone]
            held = [] if kind == "edit" else [h for h in held if h[1] < most]
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["session", "idx", "closed_at", "why"])

    return stream.groupBy("session").applyInPandasWithState(run, ENDED, "held string", "append", GroupStateTimeout.NoTimeout)


VERDICTS = "session long, idx long, verdict string"


def starvation_stream(stream: DataFrame) -> DataFrame:
    """The streaming twin of `operators.sessions.starvation` for rows (session, idx, kind, command), in the order of idx.

    State holds a session's last command and whether an edit has come since.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, edited = tuple(state.get) if state.exists else (None, False)
        out = []
        for idx, kind, command in pd.concat(list(batches)).sort_values("idx")[["idx", "kind", "command"]].itertuples(index=False, name=None):
            if kind == "edit":
                edited = True
                continue
            if last is not None:
                out.append((key[0], int(idx), "validation" if edited else "equivalent" if command == last else "narrowed" if command.startswith(last + " ") else "other"))
            last, edited = command, False
        state.update((last, edited))
        yield pd.DataFrame(out, columns=["session", "idx", "verdict"])

    return stream.groupBy("session").applyInPandasWithState(run, VERDICTS, "command string, edited boolean", "append", GroupStateTimeout.NoTimeout)


KEPT = "name string, lines long, bytes long, head string, tail string"


def retained(stream: DataFrame, room: int) -> DataFrame:
    """Bounded retention of endless streams (name, seq, text): exact counts, the first lines and the last, half of `room` bytes each.

    A row for each stream that has moved on; state holds no more than `room` bytes of text and the counts.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else {"lines": 0, "bytes": 0, "head": [], "used": 0, "open": True, "tail": []}
        for text in pd.concat(list(batches)).sort_values("seq")["text"]:
            n = len(text.encode()) + 1
            s["lines"], s["bytes"] = s["lines"] + 1, s["bytes"] + n
            if s["open"] and s["used"] + n <= room // 2:
                s["head"].append(text)
                s["used"] += n
            else:
                s["open"] = False
                s["tail"].append(text)
                while s["tail"] and sum(len(t.encode()) + 1 for t in s["tail"]) > room // 2:
                    s["tail"].pop(0)
        state.update((json.dumps(s),))
        yield pd.DataFrame([(key[0], s["lines"], s["bytes"], "\n".join(s["head"]), "\n".join(s["tail"]))], columns=["name", "lines", "bytes", "head", "tail"])

    return stream.groupBy("name").applyInPandasWithState(run, KEPT, "kept string", "update", GroupStateTimeout.NoTimeout)


def spent(rows: DataFrame, key: str, amount: str) -> DataFrame:
    """Running total of each key; update or complete mode."""
    return rows.groupBy(key).agg(F.sum(amount).alias("spent"), F.count(F.lit(1)).alias("n"))
