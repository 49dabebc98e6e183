"""Further queries of the engine: references, runners, traces, candidates, sessions, bounded views.  See `queries` for what
stands for what."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import combine, evidence, facts, graph, parsers, profiles, runners, search, sessions
from .queries import CHANGED, DECLS, EDGES, FAILS, INNER, LINES, NOISY, PAGE_LINES, SLOTS, TEMPLATES, _k, _noisy, _q, _sql_rank, query
from .sources import tables as S

COMMITS = "commits as (select o_orderkey as commit, o_orderdate as \"at\", 'c' || o_custkey % 10 as author, o_orderpriority as text from orders), cfiles as (select cast(l_partkey as varchar) as file, o_orderkey as commit, o_orderdate as \"at\" from lineitem join orders on l_orderkey = o_orderkey)"
WORD = "'(^|[^A-Za-z0-9_])onerly([^A-Za-z0-9_]|$)'"

# -- sources ------------------------------------------------------------------------------------------------------


@query("refs", f"with {LINES} select file, line, case when cast(file as bigint) % 3 = 0 then 'textual' else 'exact' end as engine from lines where regexp_matches(text, {WORD})")
def refs(spark, d):
    return _q(spark, d, "refs onerly").df


@query("search_sym", f"with {LINES}, {DECLS} select file, line from lines where regexp_matches(lower(text), 'e') and file in (select file from decls where symbol = 's77')")
def search_sym(spark, d):
    return _q(spark, d, "search sym:s77 e").df.select("file", "line")


@query("search_lang", f"with {LINES} select file, line from lines where contains(text, 'erly') and file in (select cast(doc_id as varchar) from documents where lang = 'en')")
def search_lang(spark, d):
    return _q(spark, d, "search lang:en case:yes erly").df.select("file", "line")


@query("commits_stage", f"with {COMMITS} select * from commits where regexp_matches(text, '(?i)urgent|high') and \"at\" >= timestamp '1996-01-01' and \"at\" < timestamp '1998-01-01' and author = 'c3' order by \"at\" desc, commit limit 40")
def commits_stage(spark, d):
    return _q(spark, d, "commits 'urgent|high' after:1996-01-01 before:1998-01-01 author:c3 --max 40").df


@query("history_stage", f"with {COMMITS}, r as (select cast(p_partkey as varchar) as file, p_name from part), first as (select distinct file from r order by file limit 24), l as (select file, arg_max(commit, (\"at\", commit)) as last_commit, max(\"at\") as last_at from cfiles where file in (from first) group by file) select r.*, last_commit, last_at from r left join l on r.file = l.file")
def history_stage(spark, d):
    rows = S.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file"), "p_name")
    return evidence.history(rows, S.commit_files(spark, d))[0]


@query("outline", f"with {LINES}, {DECLS}, f as (select distinct file from lines where contains(text, 'erly') order by file limit 12) select file, line_a as line, kind || ' ' || symbol as text from decls where file in (from f)")
def outline(spark, d):
    return _q(spark, d, "search case:yes erly | outline").df


@query("files_defining", f"with {DECLS} select kind, count(distinct file) as files, count(distinct symbol) as symbols from decls group by kind")
def files_defining(spark, d):
    return evidence.defining(S.decls(spark, d))


@query("transcript_calls", """with c as (select conv_id as session, turn as idx, 't' || turn as id, case turn % 3 when 0 then 'bash' when 1 then 'read' else 'edit' end as name, strlen(text) as size from conversations)
 select a.session, a.idx, a.id, a.name, cast(case when a.idx % 5 <> 4 then b.size end as bigint) as size from c a left join c b on b.session = a.session and b.idx = a.idx + 1""")
def transcript_calls(spark, d):
    c = S.table(spark, d, "conversations")
    name = F.when(F.col("turn") % 3 == 0, "bash").when(F.col("turn") % 3 == 1, "read").otherwise("edit")
    use = F.concat(F.lit('{"type":"tool_use","id":"t'), F.col("turn").cast("string"), F.lit('","name":"'), name, F.lit('"}'))
    result = F.concat(F.lit('{"type":"tool_result","tool_use_id":"t'), (F.col("turn") - 1).cast("string"), F.lit('","size":'), F.octet_length("text").cast("string"), F.lit("}"))
    # every fifth call is never answered; a broken line follows each message
    parts = F.when((F.col("turn") > 0) & ((F.col("turn") - 1) % 5 != 4), F.concat_ws(",", result, use)).otherwise(use)
    good = c.select(F.col("conv_id").alias("session"), F.col("turn").alias("idx"), F.concat(F.lit('{"content":['), parts, F.lit("]}")).alias("json"))
    return sessions.tool_calls(good.unionByName(good.withColumn("json", F.lit('{"content":[{"type":'))))


@query("intake_kinds", "select doc_id, case doc_id % 3 when 0 then 'utf-16' when 1 then 'binary' else 'text' end as kind, case when doc_id % 3 <> 1 then md5(text) end as text_md5 from documents")
def intake_kinds(spark, d):
    t = F.col("text")
    data = F.when(F.col("doc_id") % 3 == 0, F.encode(t, "UTF-16")).when(F.col("doc_id") % 3 == 1, F.encode(F.concat(t.substr(1, 100), F.lit("\x00"), t), "UTF-8")).otherwise(F.encode(t, "UTF-8"))
    return evidence.intake(S.table(spark, d, "documents").select("doc_id", data.alias("data"))).select("doc_id", "kind", F.md5("text").alias("text_md5"))


@query("evidence_files", "select regexp_replace(url, '^[a-z]+://', '') as file, cast(strlen(html) as bigint) as size from pages where regexp_matches(regexp_replace(url, '^[a-z]+://', ''), '^(.*/)?[^/]*en[^/]*(/.*)?$') order by file, size limit 15")
def evidence_files(spark, d):
    pages = S.table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("file"), F.octet_length("html").cast("long").alias("size"))
    return evidence.files_like(pages, "*en*", 15)[0]


@query("evidence_search", f"with {LINES} select file, line, cast(instr(text, 'thand') as bigint) as col from lines where contains(text, 'thand') order by file, line limit 30")
def evidence_search(spark, d):
    return evidence.literal_hits(S.table(spark, d, "documents"), "thand", 30)


# -- signals, focus and shapes ------------------------------------------------------------------------------------


@query("extended_rank", f"with {LINES}, {NOISY}, x as (select file, line, case when line % 9 = 8 then 'lib.io.KeyError: ' || text else text end as text from noisy) select rank, count(*) as n from (select cast(case when regexp_matches(text, '^[ \\t]*([A-Za-z_][A-Za-z0-9_]*[.])*[A-Z][A-Za-z0-9_]*(Error|Exception)(:|$)') then 3 else {_sql_rank('text')} end as bigint) as rank from x) group by rank")
def extended_rank(spark, d):
    x = _noisy(spark, d).withColumn("text", F.when(F.col("line") % 9 == 8, F.concat(F.lit("lib.io.KeyError: "), "text")).otherwise(F.col("text")))
    return x.groupBy(T.extended_rank(F.col("text")).cast("long").alias("rank")).agg(F.count(F.lit(1)).alias("n"))


FOCUS = f"""foc as (select file, line, contains(lower(text), 'erly')::int + contains(lower(text), 'thand')::int as hits, {_sql_rank('text')} as rank from noisy), f2 as (select *, row_number() over (partition by file, hits = 0 order by case when hits = 0 then -rank else -hits end, line) as place from foc where hits > 0 or rank > 0),
 sp as (select file, least(2, sum((hits = 0)::int)) as spare from f2 group by file)"""


@query("focused_lines", f"with {LINES}, {NOISY}, {FOCUS} select f2.file, line, case when hits = 0 then 'signal' else 'focus' end as why from f2 join sp on f2.file = sp.file where case when hits = 0 then place <= 2 else place <= 4 - spare end")
def focused_lines(spark, d):
    return evidence.focused(_noisy(spark, d), ["erly", "thand"], T.signal_rank(F.col("text")))


@query("message_order", f"with {PAGE_LINES}, {SLOTS}, m as (select skeleton as key, count(*) as n, max(line) as last, min(line) as first, max(contains(skeleton, 'div')::int) as focus, max({_sql_rank('skeleton')}) as tier from sk group by skeleton) select key, n, cast(row_number() over (order by focus desc, tier desc, n, last desc, first, key) as bigint) as place from m order by place limit 50")
def message_order(spark, d):
    rows = profiles.slots(S.page_lines(spark, d))
    m = rows.groupBy(F.col("skeleton").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last"), F.min("line").alias("first"), F.max(F.col("skeleton").contains("div").cast("int")).alias("focus"), F.max(T.signal_rank(F.col("skeleton"))).alias("tier"))
    return evidence.page(m, evidence.message_order(m), 1, 50).select("key", "n", F.col("place").cast("long").alias("place"))


@query("exceptional_ranked", f"with {LINES}, {NOISY}, {TEMPLATES.replace('from lines', 'from noisy')}, c as (select file, template, count(*) as n from tpl group by all), x as (select t.file, t.line, {_sql_rank('t.text')} as rank from tpl t join c on t.file = c.file and t.template = c.template where c.n <= 2), r as (select *, row_number() over (partition by file order by rank desc, line) as place from x) select file, line, cast(rank as bigint) as rank, place from r where place <= 12")
def exceptional_ranked(spark, d):
    from pyspark.sql import Window

    rows = profiles.exceptional(_noisy(spark, d)).withColumn("rank", T.signal_rank(F.col("text")).cast("long"))
    by = Window.partitionBy("file").orderBy(F.desc("rank"), "line")
    return rows.withColumn("place", F.row_number().over(by).cast("long")).where("place <= 12").select("file", "line", "rank", "place")


@query("text_shapes", f"with {PAGE_LINES}, x as (select *, row_number() over (partition by file order by line) as r from lines where regexp_matches(text, '[^ \\t\\r]')), g as (select file, count(*) as lines, cast(sum(regexp_matches(text, '<(p|div|a)[ >]')::int) as bigint) as levels from x where r <= 200 group by file) select *, case when lines >= 20 and levels * 100 >= 40 * lines then 'log' else 'prose' end as shape from g")
def text_shapes(spark, d):
    return evidence.text_shape(S.page_lines(spark, d), "<(p|div|a)[ >]", least=20)


@query("search_census", f"with {LINES} select count(*) as matches, count(distinct file) as files, cast(coalesce(sum(regexp_matches(text, '^(The|In) ')::int), 0) as bigint) as definitions, coalesce(sum(regexp_matches(text, '^(The|In) ')::int), 0) >= greatest(3, count(*) // 2) or count(distinct file) >= 12 as structural from lines where contains(text, 'erly')")
def search_census(spark, d):
    return evidence.search_census(_q(spark, d, "search case:yes erly").df, "^(The|In) ")


@query("field_counts", "with r as (select case when c_custkey % 50 = 0 then ' ' when c_custkey % 20 = 0 then 'a;b' else c_custkey || ';' || c_name || ';x' end as line from customer), n as (select case when trim(line) = '' then null else len(string_split(line, ';')) end as f, count(*) as n from r group by 1) select cast(sum(n) as bigint) as rows, cast(coalesce(sum(case when f is null then n end), 0) as bigint) as blank, min(f) as fewest, max(f) as most, arg_max(f, case when f is not null then n end) as usual, cast(sum(case when f is not null then n end) - max(case when f is not null then n end) as bigint) as ragged from n")
def field_counts(spark, d):
    line = F.when(_k() % 50 == 0, " ").when(_k() % 20 == 0, "a;b").otherwise(F.concat_ws(";", _k().cast("string"), "c_name", F.lit("x")))
    return evidence.field_counts(S.table(spark, d, "customer").select(line.alias("line")), ";")


def _cells(spark, d):
    c = S.table(spark, d, "customer")
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), v.cast("string").alias("cell")) for n, v in (("key", _k()), ("name", F.col("c_name")), ("balance", F.round("c_acctbal").cast("long")), ("mixed", F.when(_k() % 2 == 0, _k().cast("string")).otherwise("n/a")))])
    return c.select(F.explode(pairs).alias("x")).select("x.*")


@query("data_shape", "with c as (select 'key' as \"column\", c_custkey::varchar as cell from customer union all select 'name', c_name from customer union all select 'balance', round(c_acctbal)::bigint::varchar from customer union all select 'mixed', case when c_custkey % 2 = 0 then c_custkey::varchar else 'n/a' end from customer) select \"column\", count(*) as cells, cast(sum(regexp_matches(cell, '^[+-]?[0-9]+([.][0-9]*)?$')::int) as bigint) as numbers, sum(regexp_matches(cell, '^[+-]?[0-9]+([.][0-9]*)?$')::int) * 100 >= 60 * count(*) as numeric from c group by 1")
def data_shape(spark, d):
    return evidence.data_shape(_cells(spark, d))


@query("jsonl_levels", "select event_type as level, count(*) as n from events group by 1")
def jsonl_levels(spark, d):
    json = F.to_json(F.struct(F.col("event_type").alias("level"), "value"))
    return S.table(spark, d, "events").select(profiles.pointer(json, "/level").alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("lint_severity", "with x as (select 'src/f' || c_custkey % 40 || '.py' as file, c_custkey as line, case c_custkey % 3 when 0 then 'error' when 1 then 'warning' else 'info' end as severity, 'R' || c_custkey % 7 as rule from customer) select severity, rule, count(*) as n, count(distinct file) as files, min(line) as first, max(line) as last from x group by severity, rule")
def lint_severity(spark, d):
    text = F.concat(F.lit("src/f"), (_k() % 40).cast("string"), F.lit(".py:"), _k().cast("string"), F.lit(":7: "), F.when(_k() % 3 == 0, "error").when(_k() % 3 == 1, "warning").otherwise("info"), F.lit(": no [R"), (_k() % 7).cast("string"), F.lit("]"))
    rule = F.lit("^(\\S+?):([0-9]+):[0-9]+: (error|warning|info): .*\\[([^\\]]+)\\]$")
    of = lambda i: F.regexp_extract("text", "^(\\S+?):([0-9]+):[0-9]+: (error|warning|info): .*\\[([^\\]]+)\\]$", i)
    x = S.table(spark, d, "customer").select(text.alias("text")).where(F.regexp_like("text", rule))
    x = x.select(of(1).alias("file"), of(2).cast("long").alias("line"), of(3).alias("severity"), of(4).alias("rule"))
    return x.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"), F.min("line").alias("first"), F.max("line").alias("last"))


# -- runners and traces -------------------------------------------------------------------------------------------


def _reports(spark, d, text, schema, parse):
    return parsers.per_text(S.table(spark, d, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text", schema, parse)


def _ks():
    return _k().cast("string")
_REPORT = "test, outcome, error, file, line"


@query("go_report", "select c_custkey, 'TestA' || c_custkey as test, 'FAILED' as outcome, 'TestFailure' as error, 'pkg/a_test.go' as file, c_custkey as line from customer union all select c_custkey, 'TestB', 'FAILED', 'TestFailure', null, null from customer where c_custkey % 3 = 0")
def go_report(spark, d):
    text = F.concat(F.lit("=== RUN   TestA\n    pkg/a_test.go:"), _ks(), F.lit(": want 1\n    pkg/b.go:9: later\n--- FAIL: TestA"), _ks(), F.lit(" (0.00s)\n"), F.when(_k() % 3 == 0, "=== RUN   TestB\n--- FAIL: TestB (0.01s)\n").otherwise("--- PASS: TestC\n"), F.lit("FAIL\n"))
    return _reports(spark, d, text, runners.TESTS, runners.go_report)


@query("cargo_report", "select c_custkey, 'm::a' as test, 'FAILED' as outcome, 'panic' as error, 'src/a.rs' as file, c_custkey as line from customer union all select c_custkey, 'm::b', 'FAILED', 'panic', case when c_custkey % 2 = 0 then 'src/b.rs' end, case when c_custkey % 2 = 0 then c_custkey + 1 end from customer")
def cargo_report(spark, d):
    text = F.concat(F.lit("running 3 tests\ntest m::a ... FAILED\ntest m::ok ... ok\ntest m::b ... FAILED\n\nfailures:\n---- m::a stdout ----\nthread 'm::a' panicked at src/a.rs:"), _ks(), F.lit(":5:\nno\n"), F.when(_k() % 2 == 0, F.concat(F.lit("thread 'm::b' panicked at 'x', src/b.rs:"), (_k() + 1).cast("string"), F.lit(":3\n"))).otherwise(""), F.lit("test result: FAILED. 1 passed; 2 failed; 0 ignored; 0 measured\n"))
    return _reports(spark, d, text, runners.TESTS, runners.cargo_report)


@query("cargo_totals", "select c_custkey, 1 + c_custkey % 5 as passed, cast(2 as bigint) as failed, c_custkey % 2 as ignored, cast(2 as bigint) as suites from customer")
def cargo_totals(spark, d):
    text = F.concat(F.lit("test result: FAILED. 1 passed; 2 failed; 0 ignored; 0 measured\ntest result: ok. "), (_k() % 5).cast("string"), F.lit(" passed; 0 failed; "), (_k() % 2).cast("string"), F.lit(" ignored\n"))
    return _reports(spark, d, text, runners.CARGO_TOTALS, runners.cargo_totals)


@query("unittest_report", "select c_custkey, 'pkg.T.test_' || c_custkey as test, case when c_custkey % 2 = 0 then 'FAILED' else 'ERROR' end as outcome, case when c_custkey % 2 = 0 then 'AssertionError' else 'KeyError' end as error, case when c_custkey % 4 <> 0 then 'pkg/mod.py' end as file, case when c_custkey % 4 <> 0 then c_custkey end as line from customer")
def unittest_report(spark, d):
    name = F.concat(F.lit("test_"), _ks())
    inside = F.when(_k() % 2 == 0, F.concat(F.lit("pkg.T."), name)).otherwise(F.lit("pkg.T"))
    text = F.concat(
        F.when(_k() % 2 == 0, "FAIL: ").otherwise("ERROR: "), name, F.lit(" ("), inside, F.lit(')\n-----\nTraceback (most recent call last):\n  File "/w/pkg/t.py", line 3, in x\n    go()\n  File "'), F.when(_k() % 4 == 0, "/usr/lib/x.py").otherwise("/w/pkg/mod.py"), F.lit('", line '), _ks(),
        F.lit(", in go\n    y()\n"), F.when(_k() % 2 == 0, "AssertionError: 1 != 2\n").otherwise("KeyError: 'k'\n"), F.lit('  File "/w/pkg/after.py", line 1\n\nRan 1 test in 0.1s\n\nFAILED (failures=1)\n'),
    )
    return _reports(spark, d, text, runners.TESTS, lambda t: runners.unittest_report(t, "/w/"))


@query("jest_report", "select c_custkey, 'src/a' || c_custkey || '.test.js' as test, 'FAILED' as outcome, 'TestFailure' as error, cast(null as varchar) as file, cast(null as bigint) as line from customer union all select c_custkey, 'adds numbers', 'FAILED', 'TestFailure', null, null from customer where c_custkey % 2 = 0")
def jest_report(spark, d):
    text = F.concat(F.lit(" FAIL  src/a"), _ks(), F.lit(".test.js\n"), F.when(_k() % 2 == 0, "    ✕ adds numbers (12 ms)\n    ✕ adds numbers (3 ms)\n").otherwise("    ✓ adds\n"), F.lit("Tests:       1 failed, 2 passed, 3 total\n"))
    return _reports(spark, d, text, runners.TESTS, runners.jest_report)


@query("jest_counts", "select c_custkey, 'tests' as label, c_custkey % 3 as failed, cast(2 as bigint) as passed, 2 + c_custkey % 3 as total from customer union all select c_custkey, 'test suites', 1, 0, 1 from customer")
def jest_counts(spark, d):
    failed = F.when(_k() % 3 == 0, "").otherwise(F.concat((_k() % 3).cast("string"), F.lit(" failed, ")))
    text = F.concat(F.lit("Test Suites: 1 failed, 1 total\nTests:       "), failed, F.lit("2 passed, "), (2 + _k() % 3).cast("string"), F.lit(" total\n"))
    return _reports(spark, d, text, runners.JEST_COUNTS, runners.jest_counts)


TRACES = (
    "Traceback (most recent call last):\n  File \"app/a.py\", line 1, in a\n    b()\n  File \"/x/site-packages/q.py\", line 2, in b\nValueError: no\n\nDuring handling of the above exception, another exception occurred:\n\nTraceback (most recent call last):\n  File \"app/c.py\", line 3, in c\n  [Previous line repeated 4 more times]\nKeyError: 'k'\n",
    "Exception in thread \"main\" java.lang.IllegalStateException: bad\n\tat com.acme.A.go(A.java:7)\n\tat java.util.List.of(List.java:9)\nCaused by: java.io.IOException: disk\n\tat org.apache.x.Y.z(Y.java:1)\n",
    "TypeError: x is undefined\n    at go (/srv/app/a.js:10:5)\n    at /srv/node_modules/b/b.js:2:1\n    at node:internal/main:3:4\nlater\n",
    "panic: oh\n\ngoroutine 1 [running]:\nmain.go1(0x1)\n\t/srv/app/main.go:12 +0x1d\nruntime.main()\n\t/usr/local/go/src/runtime/proc.go:250 +0x2\n",
    "thread 'main' panicked at 'no', src/main.rs:4:5\nstack backtrace:\n   0: std::panicking\n             at /rustc/abc/library/std/src/panicking.rs:5:1\n   1: app::main\n             at ./src/main.rs:4:5\n",
)
_TRACE_ROWS = (
    (0, 0, "python", None, 2, 1, "app/a.py:1", "ValueError: no"), (0, 1, "python", "during", 5, 5, "app/c.py:3", "KeyError: ''k''"), (1, 0, "java", None, 2, 1, "com.acme.A.go:7", 'Exception in thread "main" java.lang.IllegalStateException: bad'),
    (1, 1, "java", "caused-by", 1, 0, None, "java.io.IOException: disk"), (2, 0, "javascript", None, 3, 1, "/srv/app/a.js:10", "TypeError: x is undefined"), (3, 0, "go", None, 2, 1, "/srv/app/main.go:12", "panic: oh"), (4, 0, "rust", None, 2, 1, "./src/main.rs:4", "thread ''main'' panicked at ''no'', src/main.rs:4:5"),
)
_TRACE_SQL = ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in _TRACE_ROWS)


@query("trace_report", f"select c_custkey, cast(trace as bigint) as trace, language, link, cast(frames as bigint) as frames, cast(own as bigint) as own_frames, place as own_place, error from customer join (values {_TRACE_SQL}) t(k, trace, language, link, frames, own, place, error) on c_custkey % 5 = k")
def trace_report(spark, d):
    text = F.element_at(F.array(*[F.lit(t) for t in TRACES]), (_k() % 5 + 1).cast("int"))
    return _reports(spark, d, text, runners.REPORT, runners.trace_report)


@query("prefix_counts", "select c_custkey::varchar as file, 'a/x.py' as path, 1 + c_custkey % 4 as adds, cast(1 as bigint) as dels from customer union all select c_custkey::varchar, 'b.py', 0, 1 from customer")
def prefix_counts(spark, d):
    adds = F.repeat(F.lit("+new\n"), (_k() % 4).cast("int"))
    text = F.concat(F.lit("diff --git a/a/x.py b/a/x.py\n--- a/a/x.py\n+++ b/a/x.py\n@@ -1 +1 @@\n-old\n+new\n"), adds, F.lit("diff --git a/b.py b/b.py\n--- a/b.py\n+++ b/b.py\n@@ -1 +0,0 @@\n-gone\n"))
    return evidence.prefix_counts(S.lines(S.table(spark, d, "customer").select("c_custkey", text.alias("text")), "c_custkey"))


@query("python_outline", "select c_custkey, 'A' as symbol, 'class' as kind, cast(1 as bigint) as line_a, 3 + c_custkey % 3 as line_b, cast(null as varchar) as scope from customer where c_custkey % 7 <> 0 union all select c_custkey, 'A.f', 'method', 2, 3 + c_custkey % 3, 'A' from customer where c_custkey % 7 <> 0 union all select c_custkey, 'g' || c_custkey, 'function', 4 + c_custkey % 3, 5 + c_custkey % 3, null from customer where c_custkey % 7 <> 0")
def python_outline(spark, d):
    text = F.concat(F.lit("class A:\n    def f(self):\n        x = 1\n"), F.repeat(F.lit("        x = 2\n"), (_k() % 3).cast("int")), F.lit("def g"), _ks(), F.when(_k() % 7 == 0, F.lit("(:\n")).otherwise(F.lit("():\n    pass\n")))
    return _reports(spark, d, text, parsers.SYMBOLS, parsers.python_symbols)


# -- joins, candidates and graphs ---------------------------------------------------------------------------------


@query("inheritance", "with b as (select p_partkey as sub, p_partkey // 16 as name, p_size % 5 as home from part), j as (select a.sub, b.sub as base, case when a.home = b.home then 0 when (a.home + b.home) % 2 = 0 then 1 else 2 end as tier from b a join b on a.name = b.name and a.sub <> b.sub) select sub, base, cast(tier as bigint) as tier from j qualify tier = min(tier) over (partition by sub)")
def inheritance(spark, d):
    name = F.floor(F.col("p_partkey") / 16)
    p = S.table(spark, d, "part").select(F.col("p_partkey").alias("call"), name.alias("name"), (F.col("p_size") % 5).alias("h"))
    bases = p.select("name", F.col("call").alias("base"), F.col("h").alias("g"))
    tier = F.when(F.col("call") == F.col("base"), 9).when(F.col("h") == F.col("g"), 0).when((F.col("h") + F.col("g")) % 2 == 0, 1).otherwise(2)
    return facts.best_tier(p, bases, tier).where("call <> base").select(F.col("call").alias("sub"), "base", F.col("tier").cast("long").alias("tier"))


@query("related_tests", """with f as (select n_nationkey as file, lower(replace(n_name, ' ', '_')) as stem from nation), t as (select c_custkey as test, case c_custkey % 4 when 0 then 'test_' || stem when 1 then stem || '_test' else 'x' || c_custkey end as name, 'import os' || chr(10) || 'import ' || stem || 'x, y' || chr(10) || case when c_custkey % 3 = 0 then 'import ' || stem else '' end as text from customer join f on c_nationkey = f.file)
 select f.file, t.test, case when t.name in ('test_' || stem, stem || '_test') then 'name' else 'text' end as reason from f join t on t.name in ('test_' || stem, stem || '_test') or regexp_matches(t.text, '(^|[^A-Za-z0-9_])import ' || stem || '([^A-Za-z0-9_]|$)')""")
def related_tests(spark, d):
    f = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("file"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("stem"))
    t = S.table(spark, d, "customer").join(f, F.col("c_nationkey") == F.col("file"))
    name = F.when(_k() % 4 == 0, F.concat(F.lit("test_"), "stem")).when(_k() % 4 == 1, F.concat("stem", F.lit("_test"))).otherwise(F.concat(F.lit("x"), _ks()))
    text = F.concat(F.lit("import os\nimport "), "stem", F.lit("x, y\n"), F.when(_k() % 3 == 0, F.concat(F.lit("import "), "stem")).otherwise(""))
    return evidence.related_tests(f, t.select(F.col("c_custkey").alias("test"), name.alias("name"), text.alias("text")))


_CAUSES = f"""{FAILS}, {CHANGED}, {DECLS}, {INNER}, tch as (select file from changed where generation = 'g2'), causes as (select test, file, line, failure_class, symbol from inner_ where rn = 1 and file in (from tch)
 union all select test, file, line, failure_class, null from fails where file in (from tch) and file not in (select file from decls)), cand as (select coalesce(symbol, '(file-level)') as symbol, file, min(line) as line, count(distinct test) as n_tests, string_agg(distinct test, ',' order by test) as tests, string_agg(distinct failure_class, ',' order by failure_class) as classes from causes group by 1, 2)"""


def _candidates(spark, d):
    return evidence.candidates(facts.root_cause(S.fails(spark, d), S.changed(spark, d), S.decls(spark, d), "g2"))


@query("candidate_buckets", f"with {_CAUSES} select * from cand")
def candidate_buckets(spark, d):
    return _candidates(spark, d)


@query("candidate_ranking", f"with {_CAUSES}, r as (select *, row_number() over (order by n_tests desc, (symbol = '(file-level)')::int, file, line, symbol) as place from cand) select symbol, file, n_tests, cast(place as bigint) as place from r where place <= 20")
def candidate_ranking(spark, d):
    return evidence.page(_candidates(spark, d), evidence.candidate_order(), 1, 20).select("symbol", "file", "n_tests", F.col("place").cast("long").alias("place"))


@query("candidate_counterevidence", f"with {FAILS}, {CHANGED} select test, file, 'untouched' as why from fails where file not in (select file from changed where generation = 'g2') order by test limit 20")
def candidate_counterevidence(spark, d):
    u = facts.untouched(S.fails(spark, d), S.changed(spark, d), "g2").select("test", "file", F.lit("untouched").alias("why"))
    return u.orderBy("test").limit(20)


@query("realized_coverage", "with s as (select distinct event_type as op from events where value > 1), p as (select * from (values ('error', 'cause', 0.7), ('click', 'cause', 0.6), ('view', 'usage', 0.25), ('nothing', 'test', 1.0), ('purchase', 'usage', 0.5)) t(op, dimension, share)) select dimension, round(least(1.0, sum(share))::double, 6) as coverage from s join p using (op) group by 1")
def realized_coverage(spark, d):
    steps = S.table(spark, d, "events").where("value > 1").select(F.col("event_type").alias("op"), F.lit(1).alias("rows"))
    provides = spark.createDataFrame([("error", "cause", 0.7), ("click", "cause", 0.6), ("view", "usage", 0.25), ("nothing", "test", 1.0), ("purchase", "usage", 0.5)], "op string, dimension string, share double")
    return evidence.realized(steps, provides).withColumn("coverage", F.round("coverage", 6))


@query("context_neighbors", f"with {EDGES}, b as (select dst as node, 'caller' as relation, src as other, min(line) as line from edges where tier <> 'repo' group by all union all select src, 'callee', dst, min(line) from edges where tier <> 'repo' group by all) select node, relation, other, line from (select *, row_number() over (partition by node order by relation, line, other) as r from b) where r <= 4")
def context_neighbors(spark, d):
    e = S.edges(spark, d).where("tier <> 'repo'")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return graph.around(e, nodes)


# -- sessions -----------------------------------------------------------------------------------------------------

TURNS = "turns as (select conv_id as session, turn as idx, text, strlen(text) as size from conversations)"


def _turns(spark, d):
    return S.table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("idx"), "text")


@query("edit_matches", f"with {TURNS}, e as (select session, idx, case when idx % 2 = 1 then text else 'x' end as old from turns), r as (select session, idx as t, 'before ' || text as text from turns), e2 as (select session, idx + 2 as idx, old from e), p as (select distinct session, idx, trim(unnest(string_split(old, chr(10)))) as piece from e2) select e2.session, e2.idx, (select min(r.t) from p join r on r.session = p.session and r.t < p.idx and length(piece) >= 12 and contains(r.text, piece) where p.session = e2.session and p.idx = e2.idx) as seen from e2")
def edit_matches(spark, d):
    t = _turns(spark, d)
    edits = t.select("session", (F.col("idx") + 2).alias("idx"), F.when(F.col("idx") % 2 == 1, F.col("text")).otherwise("x").alias("old"))
    return sessions.edit_matches(edits, t.withColumn("text", F.concat(F.lit("before "), "text")))


IVS = """em as (select event_id as id, 'f' || user_id % 5 as family, event_id % 3 as hints from events where event_type = 'click'), oc as (select event_id as seq, event_id - 1 - event_id % 2 as id, case user_id % 4 when 0 then 'landing' when 1 then 'rerun' when 2 then 'censored' else 'edit' end as outcome from events where event_type = 'view'),
 io as (select em.*, string_agg(outcome, ',' order by seq) as outcomes, arg_max(outcome, seq) filter (where outcome <> 'censored') as resolution from em left join oc on em.id = oc.id group by em.id, family, hints)"""


def _interventions(spark, d):
    e = S.table(spark, d, "events")
    emitted = e.where("event_type = 'click'").select(F.col("event_id").alias("id"), F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string")).alias("family"), (F.col("event_id") % 3).alias("hints"))
    u = F.col("user_id") % 4
    outcome = F.when(u == 0, "landing").when(u == 1, "rerun").when(u == 2, "censored").otherwise("edit")
    found = e.where("event_type = 'view'").select(F.col("event_id").alias("seq"), (F.col("event_id") - 1 - F.col("event_id") % 2).alias("id"), outcome.alias("outcome"))
    return sessions.outcomes(emitted, found)


@query("intervention_outcomes", f"with {IVS} select id, family, hints, coalesce(outcomes, '') as outcomes, resolution from io")
def intervention_outcomes(spark, d):
    return _interventions(spark, d)


@query("interventions_by_family", f"with {IVS} select family, count(*) as n, count(resolution) as resolved, count(*) - count(resolution) as open, cast(sum((hints > 0)::int) as bigint) as hinted, cast(sum((hints > 0 and resolution is not null)::int) as bigint) as hinted_resolved, cast(coalesce(sum((resolution = 'landing')::int), 0) as bigint) as landed, round(coalesce(sum((resolution = 'landing')::int), 0) / nullif(count(resolution), 0), 6) as rate from io group by family")
def interventions_by_family(spark, d):
    return sessions.by_family(_interventions(spark, d)).withColumn("rate", F.round("rate", 6))


@query("picker_fetches", "with p as (select o_orderkey as run, o_orderdate as at from orders), f as (select l_orderkey as run, l_shipdate as f from lineitem), g as (select p.run, count(*) as n from p join f on f.run = p.run and f.f > p.at group by 1) select p.run, p.at, coalesce(n, 0) as fetches from p left join g on p.run = g.run")
def picker_fetches(spark, d):
    picks = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("at"))
    return sessions.fetched(picks, S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_shipdate").alias("at")))


_FACT = "regexp_extract(text, '[A-Za-z]{4,}')"
FACTS = f"fct as (select session, idx, {_FACT} as fact, size from turns where {_FACT} <> ''), wrd as (select distinct session, idx as t, unnest(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+')) as fact from turns), dn as (select fct.session, fct.idx, fct.fact, any_value(fct.size) as size, min(wrd.t) as first_use from fct left join wrd on fct.session = wrd.session and fct.fact = wrd.fact and wrd.t > fct.idx group by 1, 2, 3)"


def _facts_of(spark, d):
    t = _turns(spark, d)
    fact = F.regexp_extract("text", "[A-Za-z]{4,}", 0)
    return sessions.downstream(t.select("session", "idx", fact.alias("fact"), F.octet_length("text").alias("size")).where("fact <> ''"), t)


@query("downstream_facts", f"with {TURNS}, {FACTS} select session, idx, fact, first_use from dn")
def downstream_facts(spark, d):
    return _facts_of(spark, d).select("session", "idx", "fact", "first_use")


@query("replay_regret", f"with {TURNS}, {FACTS}, x as (select 'p' || session % 4 as profile, size // 4 as tokens, size < 1000 as shown, first_use from dn) select profile, count(*) as facts, cast(sum((first_use is not null and shown)::int) as bigint) as inline, cast(sum((first_use is not null and not shown)::int) as bigint) as hop, cast(sum(tokens) as bigint) as naive, cast(coalesce(sum(case when shown then tokens end), 0) as bigint) as actual, cast(coalesce(sum(case when first_use is not null then tokens end), 0) as bigint) as oracle, cast(coalesce(sum(case when shown then tokens end), 0) - coalesce(sum(case when first_use is not null then tokens end), 0) as bigint) as regret from x group by profile")
def replay_regret(spark, d):
    x = _facts_of(spark, d).select(F.concat(F.lit("p"), (F.col("session") % 4).cast("string")).alias("profile"), F.floor(F.col("size") / 4).alias("tokens"), (F.col("size") < 1000).alias("shown"), "first_use")
    return sessions.regret(x, "profile")


STEPS = "st as (select user_id as session, event_id as idx, case event_type when 'signup' then 'edit' when 'click' then 'hypothesis' else 'command' end as kind, 'run ' || event_type || case when event_id % 3 = 0 then ' -k ' || user_id else '' end as command from events)"


def _steps(spark, d):
    kind = F.when(F.col("event_type") == "signup", "edit").when(F.col("event_type") == "click", "hypothesis").otherwise("command")
    command = F.concat(F.lit("run "), "event_type", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" -k "), F.col("user_id").cast("string"))).otherwise(""))
    return S.table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("idx"), kind.alias("kind"), command.alias("command"))


@query("hypothesis_windows", f"with {STEPS}, h as (select session, idx from st where kind = 'hypothesis'), c as (select h.session, h.idx, st.idx as t, row_number() over (partition by h.session, h.idx order by st.idx) as k from h join st on st.session = h.session and st.idx > h.idx and kind = 'command'), n as (select session, idx, t from c where k = 3), e as (select h.session, h.idx, min(st.idx) as t from h join st on st.session = h.session and st.idx > h.idx and kind = 'edit' group by all) select h.session, h.idx, least(n.t, e.t) as closed_at, case when least(n.t, e.t) is null then 'open' when least(n.t, e.t) = e.t then 'generation' else 'expired' end as why from h left join n on h.session = n.session and h.idx = n.idx left join e on h.session = e.session and h.idx = e.idx")
def hypothesis_windows(spark, d):
    return sessions.hypotheses(_steps(spark, d))


@query("starvation", f"with {STEPS}, g as (select *, sum((kind = 'edit')::int) over (partition by session order by idx) as g from st), l as (select *, lag(command) over w as c, lag(g) over w as pg from g where kind <> 'edit' window w as (partition by session order by idx)) select session, idx, case when g > pg then 'validation' when command = c then 'equivalent' when starts_with(command, c || ' ') then 'narrowed' else 'other' end as verdict from l where c is not null")
def starvation(spark, d):
    return sessions.starvation(_steps(spark, d))


@query("telemetry_gain", "select source, count(*) as calls, cast(sum(strlen(text)) as bigint) as raw, cast(sum(least(strlen(text), 500)) as bigint) as emitted, cast(greatest(0, (sum(strlen(text)) - sum(least(strlen(text), 500))) // 4) as bigint) as gain from documents group by source")
def telemetry_gain(spark, d):
    n = F.octet_length("text").cast("long")
    return sessions.telemetry(S.table(spark, d, "documents").select("source", n.alias("raw"), F.least(n, F.lit(500)).alias("emitted")), "source")


@query("session_comparison", f"with {TURNS}, s as (select session, cast(sum(size) as bigint) as tokens, count(*) > 3 as accepted, session % 5 <> 0 as complete from turns group by session), a as (select session // 2 as identity, * from s where session % 2 = 0), b as (select session // 2 as identity, * from s where session % 2 = 1) select a.identity, a.tokens, b.tokens as with_tokens, case when a.accepted and b.accepted and a.complete and b.complete then a.tokens - b.tokens end as saved from a join b on a.identity = b.identity")
def session_comparison(spark, d):
    s = _turns(spark, d).groupBy("session").agg(F.sum(F.octet_length("text")).alias("tokens"), (F.count(F.lit(1)) > 3).alias("accepted")).withColumns({"complete": F.col("session") % 5 != 0, "identity": F.floor(F.col("session") / 2)})
    return sessions.compared(s.where("session % 2 = 0"), s.where("session % 2 = 1"))


@query("language_majority", "select source, lang, n from (select source, lang, count(*) as n, row_number() over (partition by source order by count(*) desc, lang) as r from documents group by source, lang) where r = 1")
def language_majority(spark, d):
    return evidence.majority(S.table(spark, d, "documents"), "source", "lang")


@query("call_correlation", f"with {TURNS} select session, idx, lead(idx) over (partition by session order by idx) as next_idx, count(*) over (partition by session order by idx rows between 1 following and unbounded following) as later from turns")
def call_correlation(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("session").orderBy("idx")
    return _turns(spark, d).select("session", "idx", F.lead("idx").over(by).alias("next_idx"), F.count(F.lit(1)).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("later"))


@query("command_signatures", "select event_id, 'run' || case when event_type <> 'error' then ' ' || event_type else '' end as signature from events")
def command_signatures(spark, d):
    e = S.table(spark, d, "events")
    command = F.concat(F.lit("/usr/bin/run -v ./a.py "), F.when(F.col("event_type") == "error", "--all").otherwise(F.col("event_type")), F.lit("  tail"))
    return e.select("event_id", sessions.signature(F.when(F.col("event_type") == "error", F.lit("/usr/bin/run -v ./a.py --all")).otherwise(command)).alias("signature"))


@query("canonical_records", "select event_id, '{\"a\":\"' || user_id || '\",\"k\":\"' || regexp_extract(props, '[0-9]+') || '\",\"z\":\"' || event_type || '\"}' as json from events")
def canonical_records(spark, d):
    e = S.table(spark, d, "events")
    raw = F.concat(F.lit('{ "z": "'), "event_type", F.lit('", "k": '), F.regexp_extract("props", "[0-9]+", 0), F.lit(', "a": '), F.col("user_id").cast("string"), F.lit("}"))
    return e.select("event_id", sessions.canonical_json(raw).alias("json"))


# -- bounded views ------------------------------------------------------------------------------------------------


@query("all_but_last", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r > 3 and o_totalprice >= 100000")
def all_but_last(spark, d):
    return evidence.all_but_last(S.table(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, "o_totalprice", 100000).select("o_custkey", "o_orderkey")


@query("decimated_sample", "with n as (select count(*) as n from events), s as (select case when n <= 200 then 1 else 1 << cast(ceil(log2(n / 200.0)) as int) end as k from n) select event_id from events, s where event_id % k = 0")
def decimated_sample(spark, d):
    return profiles.decimated(S.table(spark, d, "events").select("event_id"), "event_id", 100)


@query("token_budget", f"with {LINES}, u as (select *, sum(strlen(text) + 1) over (partition by file order by line) as used from lines) select file, cast(sum((used <= 400)::int) as bigint) as shown, cast(coalesce(max(case when used <= 400 then used end), 0) as bigint) as used, min(case when used > 400 then line end) as next_line from u group by file")
def token_budget(spark, d):
    return evidence.within_budget(S.document_lines(spark, d), 400)


@query("result_page", f"with {LINES} select file, line, cast(place as bigint) as place from (select file, line, row_number() over (order by file, line) as place from lines where contains(text, 'erly')) where place between 21 and 40")
def result_page(spark, d):
    return evidence.page(_q(spark, d, "search case:yes erly").df, [F.col("file"), F.col("line")], 3, 10).select("file", "line", F.col("place").cast("long").alias("place")).union(
        evidence.page(_q(spark, d, "search case:yes erly").df, [F.col("file"), F.col("line")], 4, 10).select("file", "line", F.col("place").cast("long").alias("place"))
    )


@query("region_zoom", f"with {LINES}, r as (select file, cast(1 as bigint) as first, max(line) as last from lines group by file), h as (select *, 1 as half, first as a, (first + last) // 2 as b from r union all select *, 2, (first + last) // 2 + 1, last from r) select h.file, first, last, cast(half as bigint) as half, a, b, count(*) as lines, cast(sum(strlen(text)) as bigint) as bytes from h join lines l on h.file = l.file and l.line between a and b where a <= b group by all")
def region_zoom(spark, d):
    rows = S.document_lines(spark, d)
    return evidence.zoom(rows, rows.groupBy("file").agg(F.lit(1).cast("long").alias("first"), F.max("line").alias("last")))


@query("span_templates", f"with {LINES}, {TEMPLATES} select file, template, count(*) as n, min(line) as first_line from tpl where line between 3 and 9 group by file, template")
def span_templates(spark, d):
    return profiles.templates(S.document_lines(spark, d).where("line between 3 and 9"), ["file"]).select("file", "template", "n", "first_line")


@query("capped_stream", f"with {LINES}, u as (select *, sum(strlen(text) + 1) over (partition by file order by line) as a, sum(strlen(text) + 1) over (partition by file order by line desc) as b from lines) select file, line, md5(text) as text_md5, case when a <= 300 then 'head' else 'tail' end as part from u where a <= 300 or b <= 300")
def capped_stream(spark, d):
    return evidence.capped(S.document_lines(spark, d), 600).select("file", "line", F.md5("text").alias("text_md5"), "part")


@query("capped_digest", f"with {LINES}, u as (select *, strlen(text) + 1 as size, sum(strlen(text) + 1) over (partition by file order by line) as a, sum(strlen(text) + 1) over (partition by file order by line desc) as b from lines) select file, count(*) as lines, cast(sum(size) as bigint) as bytes, cast(sum((a <= 300 or b <= 300)::int) as bigint) as kept_lines, cast(coalesce(sum(case when a <= 300 or b <= 300 then size end), 0) as bigint) as kept_bytes, max(case when a <= 300 then line end) as last_head, min(case when a > 300 and b <= 300 then line end) as first_tail from u group by file")
def capped_digest(spark, d):
    return evidence.capped_digest(S.document_lines(spark, d), 600)


@query("get_bytes", "select doc_id, upper(to_hex(encode(text)[101:160])) as data from documents")
def get_bytes(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.hex(F.substring(F.encode("text", "UTF-8"), 101, 60)).alias("data"))


@query("get_symbol", f"with {LINES}, {DECLS} select distinct l.file, l.line, l.text from lines l join decls d on l.file = d.file and l.line between d.line_a and d.line_b where d.symbol = 's5'")
def get_symbol(spark, d):
    return evidence.symbol_text(S.document_lines(spark, d), S.decls(spark, d), "s5")


@query("code_context", f"with {LINES}, h as (select distinct file, line as at from lines where contains(text, 'erly')) select h.file, h.at, min(l.line) as first, max(l.line) as last, string_agg(l.text, chr(10) order by l.line) as text from h join lines l on l.file = h.file and l.line between h.at - 3 and h.at + 3 group by h.file, h.at")
def code_context(spark, d):
    return evidence.code_context(S.document_lines(spark, d), _q(spark, d, "search case:yes erly").df, 3)


@query("profile_dispatch", "select doc_id, case when contains(text, 'http') then 'links' when regexp_matches(text, '[0-9]{3}') then 'numbers' else 'prose' end as profile, case when contains(text, 'http') then cast(len(string_split(text, 'http')) - 1 as varchar) when regexp_matches(text, '[0-9]{3}') then regexp_extract(text, '[0-9]{3}') end as found from documents")
def profile_dispatch(spark, d):
    p, t = evidence.Profiles(), F.col("text")
    p.register("links", t.contains("http"), F.size(F.split(t, "http")) - 1)
    p.register("numbers", t.rlike("[0-9]{3}"), F.regexp_extract(t, "[0-9]{3}", 0))
    return p.apply(S.table(spark, d, "documents")).select("doc_id", "profile", "found")


@query("scored_lines", f"with {LINES}, s as (select file, line, case when line % 4 = 0 then 30.0 else length(text)::double end as score from lines) select file, line, score from s where score >= 30 order by score desc, file, line limit 25")
def scored_lines(spark, d):
    score = F.when(F.col("line") % 4 != 0, F.length("text"))  # gives nothing for every fourth line
    return evidence.scored(S.document_lines(spark, d), score, 30, 25, [F.col("file"), F.col("line")]).select("file", "line", "score")


@query("user_script", "select source, doc_id, cast(length(text) as bigint) as n from documents where doc_id % 2 = 0")
def user_script(spark, d):
    def script(pdf):
        pdf = pdf[pdf.doc_id % 2 == 0]
        return pdf.assign(n=pdf.text.str.len())[["source", "doc_id", "n"]]

    return evidence.user_script(S.table(spark, d, "documents").select("source", "doc_id", "text"), script, "source string, doc_id long, n long")


@query("sniffed_delimiter", "select ';' as delimiter")
def sniffed_delimiter(spark, d):
    """The delimiter of the head of a table (the feature is a sample of 64 lines)."""
    line = F.concat_ws(";", _ks(), F.concat("c_name", F.lit(", x")), "c_mktsegment")
    head = [r[0] for r in S.table(spark, d, "customer").select(line).orderBy("c_custkey").limit(64).collect()]
    return spark.createDataFrame([(profiles.sniff(head),)], "delimiter string")


@query("limit_omitted", f"with {LINES} select cast(count(*) - 25 as bigint) as n from lines where contains(text, 'erly')")
def limit_omitted(spark, d):
    """The rows that a render cap of 25 leaves out."""
    rows = _q(spark, d, "search case:yes erly").df
    return combine.top_rows(rows, 25, [F.col("file"), F.col("line")])[1].select(F.col("n").cast("long").alias("n"))


@query("index_sync", "select cast(doc_id as varchar) as file from documents where contains(lower(text), 'thand')")
def index_sync(spark, d):
    """A stored index, asked twice: the second time it is found to be in step with the data files."""
    docs = S.table(spark, d, "documents")
    search.stored_index(docs, "doc_id")
    return search.candidates(search.stored_index(docs, "doc_id"), "thand").join(docs.where(F.lower("text").contains("thand")).select(F.col("doc_id").cast("string").alias("file")), "file", "left_semi")
