import json
import os

from tracewell import queries
from tracewell.streaming import state

DIR = "/root/testdata/sf0.001"


def drained(stream, name, spark, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_circuit_stream_equals_batch(spark, tmp_path):
    rows = queries._circuit_events(spark, DIR).orderBy("seq").collect()
    for i in range(0, len(rows), 150):
        (tmp_path / f"part{i:05}.json").write_text("\n".join(json.dumps(r.asDict()) for r in rows[i : i + 150]) + "\n{broken\n")
    schema = "signature string, seq long, event string, generation string"
    stream = state.ledger(spark, str(tmp_path), schema, per_trigger=1)
    want = sorted(tuple(r) for r in state.circuit_moves(state.read_ledger(spark, str(tmp_path), schema)).collect())
    assert want and drained(state.circuit_stream(stream), "moves", spark) == want


def test_fold_and_unique(spark, tmp_path):
    a = [{"id": 1, "k": "a", "seq": 1, "v": "x", "ts": "2024-01-01T00:00:00Z"}, {"id": 1, "k": "a", "seq": 1, "v": "x", "ts": "2024-01-01T00:00:01Z"}]
    b = [{"id": 2, "k": "a", "seq": 2, "v": "y", "ts": "2024-01-01T00:00:02Z"}]
    for i, part in enumerate((a, b)):
        (tmp_path / f"{i}.json").write_text("\n".join(map(json.dumps, part)))
    schema = "id long, k string, seq long, v string, ts timestamp"
    rows = drained(state.unique(state.ledger(spark, str(tmp_path), schema, 1), "id", "ts", "1 hour").select("id"), "ids", spark)
    assert rows == [(1,), (2,)]
    last = drained(state.folded(state.ledger(spark, str(tmp_path), schema, 1), "k", "seq", "v"), "folds", spark, "complete")
    assert last == [("a", "y", 2)]


def test_followup_stream_equals_closed_windows_of_the_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from tracewell.operators import ledgers
    from tracewell.sources import tables
    from tracewell.streaming import windows

    e = tables.table(spark, DIR, "events").where("user_id % 4 = 0")
    kind = F.when(F.col("event_type") == "signup", "edit").when(F.col("event_type") == "view", "retrieval").otherwise("bash")
    acts = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("idx"), kind.alias("kind"), F.concat(F.lit("run "), F.col("props")).alias("command"), F.col("event_type").alias("signature"))
    em = e.where("event_type = 'error'").select(F.col("user_id").alias("session"), F.col("event_id").alias("idx"), F.lit("click").alias("signature"), F.lit('": 1').alias("needle"))
    want = ledgers.followup(em, acts).where("not censored").select("session", "idx", "actions", "generations", "used", "requery")
    rows = windows.turns(em, acts).orderBy("idx", "side")
    data = rows.collect()
    for i in range(0, len(data), 100):
        (tmp_path / f"{i:05}.json").write_text("\n".join(json.dumps(r.asDict()) for r in data[i : i + 100]))
    stream = state.ledger(spark, str(tmp_path), rows.schema, per_trigger=1)
    got = drained(windows.followup_stream(stream), "closed", spark)
    assert got and got == sorted(tuple(r) for r in want.collect())


def test_hypotheses_and_starvation_streams_equal_their_batches(spark, tmp_path):
    from tracewell import queries_evidence
    from tracewell.operators import sessions
    from tracewell.streaming import windows

    rows = queries_evidence._steps(spark, DIR).where("session % 5 = 0")
    data = rows.orderBy("idx").collect()
    for i in range(0, len(data), 60):
        (tmp_path / f"{i:05}.json").write_text("\n".join(json.dumps(r.asDict()) for r in data[i : i + 60]))
        os.utime(tmp_path / f"{i:05}.json", (1000 + i, 1000 + i))
    stream = lambda: state.ledger(spark, str(tmp_path), rows.schema, per_trigger=1)
    want = sessions.hypotheses(rows).where("why <> 'open'")
    got = drained(windows.hypothesis_stream(stream()), "ended", spark)
    assert got and got == sorted(tuple(r) for r in want.collect())
    got = drained(windows.starvation_stream(stream()), "verdicts", spark)
    assert got and got == sorted(tuple(r) for r in sessions.starvation(rows).collect())


def test_retention_is_bounded_and_counts_are_exact(spark, tmp_path):
    from tracewell.streaming import windows

    lines = [f"line {i} " + "x" * (i % 7) for i in range(100)]
    for k in range(4):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps({"name": "a", "seq": i, "text": lines[i]}) for i in range(25 * k, 25 * k + 25)))
        os.utime(tmp_path / f"{k}.json", (1000 + k, 1000 + k))  # files come by their time
    stream = state.ledger(spark, str(tmp_path), "name string, seq long, text string", per_trigger=1)
    name, n, size, head, tail = max(drained(windows.retained(stream, 200), "retained", spark, "update"), key=lambda r: r[1])
    assert (name, n, size) == ("a", 100, sum(len(x) + 1 for x in lines))
    assert lines[: len(head.split("\n"))] == head.split("\n") and lines[-len(tail.split("\n")) :] == tail.split("\n")
    assert 60 < len(head) + 1 <= 100 and 60 < len(tail) + 1 <= 100
