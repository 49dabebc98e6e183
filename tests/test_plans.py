import pytest

from tracewell.functions.globs import glob_regex
from tracewell.operators import parsers, profiles, rank, search
from tracewell.plans import dag, pipeline

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("bad", ["", "count", "search a | search b", "nothing", "search a | | count", "search a | get | count", "records events | get", " | ".join(["search a"] + ["count"] * 8)])
def test_pipelines_that_are_refused(bad):
    with pytest.raises(pipeline.PipelineError):
        pipeline.parse(bad)


def test_a_bar_in_quotes_is_no_bar():
    assert pipeline.split("search 'a|b' c | count") == [("search", ["a|b", "c"]), ("count", [])]


def test_caps_count_what_they_drop(spark):
    c = pipeline.Context(spark, DIR)
    every = pipeline.run(c, "search erly")
    n = every.df.count()
    for k in (0, 3, n + 5):
        f = pipeline.run(c, f"search erly | top {k}")
        assert f.df.count() == min(k, n) and f.left_out() == n - min(k, n)
    capped = pipeline.run(c, "search erly | count", row_cap=4)
    assert capped.df.first()["n"] == min(4, n)
    g = pipeline.run(c, "search erly | group file | top 2")
    assert sum(r["n"] for r in g.census().collect()) == g.df.count() == n - g.left_out()
    assert "more rows" in pipeline.run(c, "search erly").render(2)


def test_results_do_not_depend_on_partitions(spark):
    c = pipeline.Context(spark, DIR)
    out = set()
    for n in ("1", "2", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.add(pipeline.run(c, "search erly | group file | top 3").render())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(out) == 1


def test_plan_problems_come_all_at_once():
    plan = {"version": "x", "question": "", "budget": {"nodes": -1}, "requires": [{"dimension": "?"}], "steps": [
        {"id": "A", "op": "nothing"}, {"id": "a", "op": "count"}, {"id": "a", "op": "search", "input": "a", "args": [1]},
        {"id": "b", "op": "count", "input": "z", "when": "q.count > x", "on_error": "?", "on_missing": "?"},
        {"id": "c", "op": "callers", "foreach": "a.x"}, {"id": "d", "op": "callers", "foreach": "a.x", "cap": 65},
        {"id": "e", "op": "files", "input": "b"},
    ]}
    found = {p.reason for p in dag.validate(plan)}
    assert found == {"bad_schema", "bad_objective", "bad_budget", "bad_requires", "bad_id", "unknown_op", "input_required", "duplicate_id", "source_takes_no_input", "bad_args", "forward_reference", "guard_grammar", "bad_on_error", "bad_on_missing", "fanout_uncapped", "fanout_cap_exceeded", "kind_mismatch"}
    assert found <= set(dag.REASONS)
    assert [p.reason for p in dag.validate({**dag.ask("impact", "1"), "steps": dag.ask("impact", "1")["steps"] * 25})].count("node_budget_exceeded") == 1


def test_guards_skip_and_prices_add_up(spark):
    plan = {"version": dag.VERSION, "question": "q", "steps": [
        {"id": "none", "op": "search", "args": ["nowhere to be found"]},
        {"id": "files", "op": "files", "input": "none", "when": "none.count > 0"},
        {"id": "top", "op": "top", "input": "files"},
        {"id": "fan", "op": "callers", "args": ["{item}"], "foreach": "none.file", "cap": 3, "when": "files.outcome == pass"},
    ]}
    r = dag.execute(pipeline.Context(spark, DIR), plan)
    assert r.skipped == {"files": "guard_false", "top": "upstream_skipped", "fan": "guard_undecidable"}
    assert dag.price(plan) == 8 + 1 + 1 + 3


def test_globs():
    import re

    fits = lambda g, p: bool(re.match(glob_regex(g), p))
    assert fits("*.py", "a/b.py") and fits("src/*.py", "src/a.py") and not fits("src/*.py", "src/b/a.py")
    assert fits("src/**/a.py", "src/a.py") and fits("src/**/a.py", "src/x/y/a.py") and fits("[!a].c", "b.c") and not fits("[!a].c", "a.c")


def test_required_trigrams_never_lose_a_match():
    assert search.required("abcd") == "abcd"
    assert search.required("(abc|xyz)q*defg") == ["and", ["or", "abc", "xyz"], "defg"]
    assert search.required("(abc|x)") is None and search.required("a.c") is None and search.required("(foo)?bar") == "bar"


def test_parsers():
    assert parsers.collapsed(list("xababababy")) == [(["x"], 1), (["a", "b"], 4), (["y"], 1)]
    assert [b[1:6] for b in parsers.blocks("# A\ntext\n\n## B\n```\n# no\n```\nend")] == [("heading", 1, 1, 1, None), ("text", 0, 2, 2, 0), ("heading", 2, 4, 4, 0), ("code", 0, 5, 7, 2), ("text", 0, 8, 8, 2)]
    assert parsers.python_symbols("class A:\n    def f(self): pass\ndef g(): pass")[1] == ("A.f", "method", 2, 2, "A")
    assert parsers.diff_census("--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n-a\n") == [("x", 1, 0, 1, 1)]
    assert profiles.sniff(["a;b,c", "1;2", "3;4", "5;6", "7;8"]) == ";" and profiles.sniff(["just text"] * 9) is None
    assert rank.terms("find `getUser` of the user_id")[0] == ("getuser", pytest.approx(2.0 * (1 + 0.25 * 0.6931471805599453)))
    sizes = parsers.chunk_map("x" * 1000 + "\n" + "y" * 1000 + "\n\n" + "z" * 50)
    assert sum(s[3] for s in sizes) == 1001 + 1001 + 1 + 51 and sizes[0][1:3] == (1, 2)
