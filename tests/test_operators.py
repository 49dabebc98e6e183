"""Operators over small fixtures: signals, secrets, runners, traces, graphs, relays, budgets, the stored index."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import evidence, graph, ledgers, parsers, rank, runners, search, sessions
from tracewell.plans import dag, pipeline
from tracewell.sources import tables

DIR = "/root/testdata/sf0.001"

SIGNALS = {
    "no errors found": -1, "0 failed": -1, "zero failures": -1, "3 failed, 2 passed": 3, "failures: 4": 3, "--- FAIL: TestX": 3, "HTTP/1.1 502 Bad Gateway": 3, "HTTP/1.1 200 OK": 0, "status_code=503": 3,
    "exited with code 1": 3, "exit code 0": 0, "code 137 (OOMKilled)": 3, "FATAL: no space": 3, "Error: bad": 3, "an Error: bad": 1, "npm ERR! code": 3, "exceed quota": 3, "Back-off restarting failed container": 3,
    'File "a.py", line 3': 2, "src/a.go:17: note": 2, "at 09:00:13 all is well": 0, "--> src/main.rs:4": 2, "could not connect: timed out": 1, "plain": 0, "": 0,
}


def test_signal_ranks(spark):
    rows = list(SIGNALS.items())
    df = spark.createDataFrame(rows, "t string, want int").select("t", "want", T.signal_rank(F.col("t")).alias("got"))
    assert [(r["t"], r["want"], r["got"]) for r in df.collect() if r["want"] != r["got"]] == []
    assert spark.createDataFrame([("a.KeyError: 'x'",)], "t string").select(T.extended_rank(F.col("t"))).first()[0] == 3


def test_secrets_and_near_misses(spark):
    x = "Ab3" * 20
    good = [
        f"AKIA{'A1B2' * 4}", f"aws_secret_access_key: {x[:40]}", f"ghp_{x[:36]}", f"glpat-{x[:20]}", f"xoxb-{x[:20]}", f"https://hooks.slack.com/services/T{x[:24]}", f"sk_test_{x[:24]}", f"SK{'0a' * 16}", f"SG.{x[:22]}.{x[:22]}",
        f"npm_{x[:36]}", f"pypi-AgEIcHlwaS5vcmc{x[:24]}", f"hf_{x[:34]}", f"sk-ant-{x[:24]}", f"eyJ{x[:24]}.{x[:12]}.{x[:12]}", f"AIza{x[:35]}", f"sk-{x[:24]}", f"Bearer {x[:20]}", "redis://:pw@host",
        f"-----BEGIN PRIVATE KEY-----\n{x}\n-----END PRIVATE KEY-----", f"-----BEGIN PRIVATE KEY-----\n{x}",
    ]
    bad = [f"xAKIA{'A1B2' * 4}", f"AKIA{'A1B2' * 3}", f"ghp_{x[:10]}", "Bearer authentication-schemes/oauth2-bearer-tokens", "Bearer realm", "http://host/a:b", f"AIza{x[:34]}", "sk-short"]
    rows = [(i, f"so {s} there") for i, s in enumerate(good + bad)]
    got = {r["i"]: r["t"] for r in T.redacted(spark.createDataFrame(rows, "i int, t string"), "t").collect()}
    for i, s in enumerate(good):
        assert s not in got[i] and "[redacted:" in got[i], (s, got[i])
    for i, s in enumerate(bad, len(good)):
        assert got[i] == f"so {s} there", got[i]
    assert re.fullmatch(r"so \[redacted:github-token:[0-9a-f]{8}\] there", got[2])


def test_runners_leave_odd_texts_alone():
    for parse in (runners.go_report, runners.cargo_report, runners.cargo_totals, runners.unittest_report, runners.jest_report, runners.jest_counts, runners.trace_report, parsers.traces, parsers.diff_census):
        for t in ("", "\n\n", "FAIL", "x" * 10_000, "--- FAIL", "Traceback", "at (", "panicked at", "Tests:", "@@ -1 +1 @@"):
            assert isinstance(parse(t), list)
    assert runners.go_report("--- FAIL: A\n    a_test.go:3: x\n--- FAIL: B\n")[1][3:] == ("a_test.go", 3)
    assert runners.go_report("\n".join(["    a_test.go:3: x", *["y"] * 41, "--- FAIL: A"]))[0][3] is None
    far = "FAIL: a (m.T)\n" + "x\n" * 70 + '  File "/w/a.py", line 1\n'
    assert runners.unittest_report(far, "/w/") == [("m.T.a", "FAILED", "Fail", None, None)]


def test_traces_of_many_links():
    t = "".join(f"java.lang.E{i}Exception: e{i}\n\tat a.B.c(B.java:{i})\n" if i == 0 else f"Caused by: java.lang.E{i}Exception: e{i}\n\tat a.B.c(B.java:{i})\n" for i in range(5))
    assert [(r[0], r[2], r[6]) for r in runners.trace_report(t)] == [(0, None, "java.lang.E0Exception: e0"), *[(i, "caused-by", f"java.lang.E{i}Exception: e{i}") for i in range(1, 5)]]
    deep = "Traceback (most recent call last):\n" + '  File "a.py", line 1, in f\n    f()\n' * 2 + "  [Previous line repeated 996 more times]\nRecursionError: deep\n"
    assert runners.trace_report(deep)[0][3:] == (998, 998, "a.py:1", "RecursionError: deep")


def test_liveness_and_cycles_have_no_depth_limit(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(20, 21)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in (*range(13), 20, 21)], "node long")
    roots = spark.createDataFrame([(0,)], "node long")
    assert {r[0] for r in graph.dead(nodes, roots, chain).collect()} == {20, 21}


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_against_mutual_reach(spark, seed):
    r = random.Random(seed)
    edges = {(r.randrange(40), r.randrange(40)) for _ in range(60)}
    reach = {a: {b for x, b in edges if x == a} for a in range(40)}
    for _ in range(40):
        for a in reach:
            reach[a] |= {c for b in reach[a] for c in reach[b]}
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach if a in reach[a]}
    got = {x["node"]: x["component"] for x in graph.cycles(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()}
    assert got == want


def test_wide_signals_reach_all_of_1001_subscribers(spark):
    signals = spark.createDataFrame([(i, "*" if i % 2 else "s7", "interrupt" if i % 10 == 1 else "note", i, 100.0 if i % 7 else 1.0) for i in range(80)], "signal_id long, addressee string, kind string, ts long, expires_at double")
    subs = spark.range(1001).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("subscriber"))
    receipts = spark.createDataFrame([(i, "s3") for i in range(0, 80, 3)] + [(i, f"s{i}") for i in range(80)], "signal_id long, subscriber string")
    got = {}
    for r in ledgers.pending(signals, receipts, subs, F.lit(10.0), 5).collect():
        got.setdefault(r["subscriber"], []).append((r["place"], r["signal_id"]))
    assert len(got) == 1001
    rows = [(i, "*" if i % 2 else "s7", i % 10 == 1) for i in range(80) if i % 7]
    had = {(r["signal_id"], r["subscriber"]) for r in receipts.collect()}
    for s in ("s0", "s3", "s7", "s31", "s1000"):
        due = sorted((not intr, i) for i, a, intr in rows if a in ("*", s) and (i, s) not in had)[:5]
        assert sorted(got[s]) == [(k + 1, i) for k, (_, i) in enumerate(due)], s


def test_fit_is_the_longest_prefix(spark):
    r = random.Random(4)
    rows = [(i, r.choice((0, 1, 5, 30)), r.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, cost long, score double").repartition(5)
    for room in (0, 7, 100, 10**6):
        want, used = set(), 0
        for i, c, _ in sorted(rows, key=lambda x: (-x[2], x[0])):
            used += c
            if used > room:
                break
            want.add((i, used))
        assert {(x["i"], x["used"]) for x in rank.fit(df, "cost", room, [F.desc("score"), F.col("i")]).collect()} == want


def test_stored_index_follows_its_files(spark, tmp_path):
    at = f"{tmp_path}/docs"
    put = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(at)
    put([(1, "alpha beta"), (2, "gamma")])
    index = f"{tmp_path}/index"
    found = lambda w: sorted(r[0] for r in search.candidates(search.stored_index(spark.read.parquet(at), "doc_id", index), w).collect())
    assert found("alpha") == ["1"]
    put([(3, "alphabet")])
    assert found("alpha") == ["1", "3"] and found("gamma") == ["2"]
    search._SEGMENTS.clear()  # as in another process
    assert found("alpha") == ["1", "3"] and len(search._SEGMENTS[index]) == 2
    first = next(p for p in (tmp_path / "docs").glob("part-*.parquet") if spark.read.parquet(str(p)).where("doc_id = 1").count())
    first.unlink()
    spark.catalog.refreshByPath(at)
    assert found("alpha") == ["3"] and found("gamma") == []
    for i in range(search.MOST_SEGMENTS + 2):
        put([(10 + i, f"delta{i} alpha")])
        search.stored_index(spark.read.parquet(at), "doc_id", index)
    assert len(search._SEGMENTS[index]) <= search.MOST_SEGMENTS and len(found("alpha")) == search.MOST_SEGMENTS + 3


def test_filters_that_do_not_apply_are_refused(spark):
    c = pipeline.Context(spark, DIR)
    for q in ("search x author:b", "search x after:2020-01-01", "commits x sym:y"):
        with pytest.raises(ValueError, match="does not apply"):
            pipeline.run(c, q)


def test_a_text_is_searched_whole_only_if_no_line_end_matters(spark):
    docs = spark.createDataFrame([(1, "ab\ncd"), (2, "x\ry\nab"), (3, "zz")], "doc_id long, text string")
    for p in ("^cd$", "b$", "a.", "(?<=\\n)c", "[^x]b", "y"):
        q = search.parse_query(["case:yes", p])
        want = {tuple(r) for r in search.sites(tables.lines(docs, "doc_id"), q).collect()}
        assert {tuple(r) for r in search.sites(tables.lines(search.whole_texts(docs, "text", q), "doc_id"), q).collect()} == want


def test_faults_of_the_code_are_not_skips(spark, monkeypatch):
    c = pipeline.Context(spark, DIR)
    plan = {"version": dag.VERSION, "question": "q", "steps": [{"id": "a", "op": "where", "input": "b", "args": ["x"]}]}
    plan["steps"] = [{"id": "b", "op": "search", "args": ["x"]}, {"id": "a", "op": "where", "input": "b", "args": ["nothing"]}]
    r = dag.execute(c, plan)
    assert r.skipped == {"a": "error"} and "where takes" in r.errors["a"]
    monkeypatch.setattr(dag, "_step", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        dag.execute(c, plan)


def test_profiles_and_signatures(spark):
    p = evidence.Profiles()
    p.register("a", F.col("t").contains("a"), F.lit("A"))
    with pytest.raises(ValueError):
        p.register("a", F.lit(True), F.lit(""))
    got = [tuple(r) for r in p.apply(spark.createDataFrame([("xa",), ("b",), (None,)], "t string")).select("profile", "found").collect()]
    assert got == [("a", "A"), ("prose", None), ("prose", None)]
    rows = spark.createDataFrame([("/usr/bin/git commit -m 'x'",), ("pytest -q tests/a.py",), ("make",), ("  cargo   test --all",)], "c string")
    assert [r[0] for r in rows.select(sessions.signature(F.col("c"))).collect()] == ["git commit", "pytest", "make", "cargo test"]
