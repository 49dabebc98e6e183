"""Stateful ledgers on Structured Streaming.  Each has a batch twin that gives the same rows.

State is keyed and bounded: a circuit holds a few numbers, a window at most six actions.  Event-time limits are needed
only where rows expire (`unique`, `pending`); the others fold rows by their place in the ledger.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

# Outcomes that earn recovery.
TO_DENSE, TO_NORMAL = 2, 3


def ledger(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int = 1000) -> DataFrame:
    """An append-only JSONL folder as a stream; lines that do not parse are dropped one by one."""
    s = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType([*s.fields]).add("_corrupt_record", "string")
    rows = spark.readStream.schema(full).option("mode", "PERMISSIVE").option("maxFilesPerTrigger", per_trigger).json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.schema(StructType.fromDDL(schema).add("_corrupt_record", "string")).option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def unique(events: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Events once by id, for repeats that come within the delay."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def folded(rows: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """The newest value of each key; update mode."""
    return rows.groupBy(key).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


class Circuit:
    """normal -> dense -> bypass on starvation, back on earned positives; one move in an episode at most."""

    def __init__(self, state: tuple | None = None):
        self.state, self.episode, self.positives, self.moved = state or ("normal", "", 0, False)

    def on(self, event: str, generation: str) -> tuple[str, str] | None:
        if generation != self.episode:
            self.episode, self.moved = generation, False
        if event == "landing":
            self.positives += 1
        if self.moved:
            return None
        now = self.state
        if event == "starvation":
            nxt = {"normal": "dense", "dense": "bypass"}.get(now)
        elif event == "landing":
            nxt = "dense" if now == "bypass" and self.positives >= TO_DENSE else "normal" if now == "dense" and self.positives >= TO_NORMAL else None
        else:
            return None
        if nxt is None:
            return None
        self.state, self.positives, self.moved = nxt, 0, True
        return now, nxt

    def kept(self) -> tuple:
        return self.state, self.episode, self.positives, self.moved


MOVES = "signature string, seq long, from_state string, to_state string"
CIRCUIT_STATE = "state string, episode string, positives int, moved boolean"


def moves(signature: str, rows: Iterable[tuple[int, str, str]], circuit: Circuit) -> list[tuple]:
    return [(signature, seq, *m) for seq, event, generation in rows if (m := circuit.on(event, generation))]


def circuit_moves(events: DataFrame) -> DataFrame:
    """Batch: events (signature, seq, event, generation) -> the moves of each signature's circuit."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        out = moves(key[0], zip(pdf["seq"].tolist(), pdf["event"], pdf["generation"]), Circuit())
        return pd.DataFrame(out, columns=["signature", "seq", "from_state", "to_state"])

    return events.groupBy("signature").applyInPandas(run, MOVES)


def circuit_stream(events: DataFrame) -> DataFrame:
    """Streaming twin of circuit_moves: rows of a signature come in the order of seq."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        circuit = Circuit(tuple(state.get) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = moves(key[0], zip(rows["seq"].tolist(), rows["event"], rows["generation"]), circuit)
        state.update(circuit.kept())
        yield pd.DataFrame(out, columns=["signature", "seq", "from_state", "to_state"])

    return events.groupBy("signature").applyInPandasWithState(run, MOVES, CIRCUIT_STATE, "append", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, at: str, width: str, *keys: str) -> DataFrame:
    """Counts by event-time window: an extension, since ledgers have none."""
    return events.groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, at: str, gap: str, key: str) -> DataFrame:
    return events.groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"))
