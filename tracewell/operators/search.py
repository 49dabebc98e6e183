"""Search over lines: patterns and filters, any and all, context windows, file selection, trigram data skipping."""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import glob_regex
from ..functions.text import trigrams
from ..sources.tables import shared_dir

FILTERS = ("file", "path", "lang", "sym", "case", "type", "after", "before", "author", "rev")


@dataclass(frozen=True)
class Query:
    patterns: tuple[str, ...]
    filters: tuple[tuple[str, str, bool], ...] = field(default=())  # name, value, negated
    every: bool = False

    @property
    def exact_case(self) -> bool:
        return any(n == "case" and v in ("yes", "sensitive") for n, v, _ in self.filters) or any(c.isupper() for p in self.patterns for c in p)


def parse_query(args: list[str]) -> Query:
    """Words are patterns; name:value of a known name, with - before it for not, is a filter; --all wants all patterns."""
    patterns, filters = [], []
    for a in args:
        m = re.fullmatch(r"(-?)([a-z]+):(.+)", a)
        if m and m[2] in FILTERS:
            filters.append((m[2], m[3], m[1] == "-"))
        elif a != "--all":
            patterns.append(a)
    for p in patterns:
        re.compile(p)
    return Query(tuple(patterns), tuple(filters), "--all" in args)


def regex(query: Query, pattern: str) -> str:
    return pattern if query.exact_case else f"(?i){pattern}"


def file_test(query: Query, columns: list[str]) -> Column:
    """What the filters ask of a line's file; the scan sees it before any pattern."""
    test = F.lit(True)
    for name, value, negated in query.filters:
        if name in ("file", "path"):
            t = F.col("file").rlike(glob_regex(value) if any(c in value for c in "*?[") else value)
        elif name == "case":
            continue
        elif name in columns:
            t = F.col(name) == value
        else:
            raise ValueError(f"{name}: does not apply to these rows")
        test = test & (~t if negated else t)
    return test


def whole_texts(docs: DataFrame, text: str, query: Query) -> DataFrame:
    """Documents that may hold a matching line: each pattern that no line end can stop is tried on the whole text first."""
    if not query.patterns or any(re.search(r"[$^]|\(\?[!=<]|\\[AZzBGsSWDn]", p) for p in query.patterns):
        return docs
    test = F.lit(False)
    for p in query.patterns:
        test = test | F.col(text).rlike(regex(query, p))
    return docs.where(test)


def narrowed(lines: DataFrame, query: Query, decls: DataFrame | None = None, langs: DataFrame | None = None) -> tuple[DataFrame, Query]:
    """Lines of the files that sym: (defining files) and lang: ask for, and the query without these filters."""
    rest = []
    for name, value, negated in query.filters:
        of = None
        if name == "sym" and decls is not None:
            of = decls.where((F.col("symbol") == value) | F.col("symbol").endswith("." + value)).select("file").distinct()
        elif name == "lang" and langs is not None and "lang" not in lines.columns:
            of = langs.where(F.col("lang") == value).select("file").distinct()
        if of is None:
            rest.append((name, value, negated))
        else:
            lines = lines.join(of, "file", "left_anti" if negated else "left_semi")
    return lines, Query(query.patterns, tuple(rest), query.every)


def sites(lines: DataFrame, query: Query) -> DataFrame:
    """(file, line, col_a, col_b, text): the leftmost match of each matching line, columns from 1, the end exclusive."""
    rows = lines.where(file_test(query, lines.columns))
    at = None
    for p in query.patterns:
        start = F.regexp_instr("text", F.lit(regex(query, p)))
        size = F.length(F.regexp_substr("text", F.lit(regex(query, p))))
        one = F.when(start > 0, F.struct(start.alias("a"), (start + size).alias("b")))
        at = one if at is None else F.when(at.isNull(), one).when(one.isNull(), at).when(one["a"] < at["a"], one).otherwise(at)
    test = F.lit(False)
    for p in query.patterns:
        test = test | F.col("text").rlike(regex(query, p))
    rows = rows.where(test)
    if query.every:
        seen = rows.groupBy("file").agg(*[F.max(F.col("text").rlike(regex(query, p))).alias(f"p{i}") for i, p in enumerate(query.patterns)])
        for i in range(len(query.patterns)):
            seen = seen.where(f"p{i}")
        rows = rows.join(seen.select("file"), "file", "left_semi")
    rows = rows.withColumn("_at", at)
    return rows.select("file", "line", F.col("_at.a").cast("long").alias("col_a"), F.col("_at.b").cast("long").alias("col_b"), "text")


def windows(hits: DataFrame, around: int) -> DataFrame:
    """(file, first, last): context windows of hits, those that touch or overlap merged."""
    by = Window.partitionBy("file").orderBy("line")
    gap = F.when(F.col("line") - F.lag("line").over(by) <= 2 * around + 1, 0).otherwise(1)
    islands = hits.select("file", "line").distinct().withColumn("new", gap)
    islands = islands.withColumn("island", F.sum("new").over(by))
    return islands.groupBy("file", "island").agg(F.greatest(F.min("line") - around, F.lit(1)).alias("first"), (F.max("line") + around).alias("last")).drop("island")


def with_context(lines: DataFrame, hits: DataFrame, around: int) -> DataFrame:
    """(file, line, text) of all lines within `around` lines of a hit: an equi-join on the lines wanted."""
    want = hits.select("file", F.explode(F.sequence(F.greatest(F.col("line") - around, F.lit(1)), F.col("line") + around)).alias("line")).distinct()
    return lines.join(want, ["file", "line"]).select("file", "line", "text")


def select_files(files: DataFrame, globs: list[str], excludes: list[str]) -> DataFrame:
    """Files that fit any glob (all, if there are none) and no exclude."""
    test = F.lit(not globs)
    for g in globs:
        test = test | F.col("file").rlike(glob_regex(g))
    for g in excludes:
        test = test & ~F.col("file").rlike(glob_regex(g))
    return files.where(test)


# -- trigram data skipping ----------------------------------------------------------------------------------------


def trigram_index(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(file, gram): the distinct trigrams of each text in lower case."""
    return docs.select(F.col(key).cast("string").alias("file"), F.explode(trigrams(F.col(text))).alias("gram"))


#: Segments of a stored index above which it is written anew as one.
MOST_SEGMENTS = 16


def stored_index(docs: DataFrame, key: str, at: str | None = None, text: str = "text") -> DataFrame:
    """trigram_index(docs) as a table in the shared folder (or `at`), kept in step with the data files of docs.

    Segments are Parquet folders in the order of grams, each with the data files (path, size, time of change) it was made
    from.  A file that is new or has changed gets into a new segment; rows of files that are gone or have changed no longer
    count; above MOST_SEGMENTS segments the index is written anew.  Only the files' metadata are read to find out.
    """
    spark = docs.sparkSession
    print_of = F.concat_ws("|", F.col("_metadata.file_path"), F.col("_metadata.file_size").cast("string"), F.col("_metadata.file_modification_time").cast("string"))
    now = {r[0] for r in docs.select(print_of.alias("f")).distinct().collect()}  # a name for each data file
    name = at or f"{shared_dir(spark)}/trigrams-{hashlib.sha256('|'.join([key, text, *docs.inputFiles()]).encode()).hexdigest()[:16]}"
    if name not in _SEGMENTS:
        _SEGMENTS[name] = _manifest(spark, name)
    segments = _SEGMENTS[name]
    live = [(path, files) for path, files in segments if files & now]
    new = now - {f for _, files in live for f in files}
    if new and len(live) >= MOST_SEGMENTS:
        live, new = [], now
    if new:
        path = f"{name}/{uuid.uuid4().hex}"
        of = docs.select(F.col(key), F.col(text), print_of.alias("_f"))
        rows = of if new == now else of.where(F.col("_f").isin(sorted(new)))
        rows = rows.select(F.col(key).cast("string").alias("file"), "_f", F.explode(trigrams(F.col(text))).alias("gram"))
        rows.repartitionByRange("gram").sortWithinPartitions("gram", "file").write.parquet(path)
        live.append((path, new))
    if live != segments:
        _SEGMENTS[name] = live
        rows = [(path, f) for path, files in live for f in sorted(files)]
        spark.createDataFrame(rows, "segment string, file string").coalesce(1).write.mode("overwrite").parquet(f"{name}/manifest")
    out = None
    for path, files in live:
        seg = spark.read.schema("file string, _f string, gram string").parquet(path)
        seg = seg if files <= now else seg.where(F.col("_f").isin(sorted(files & now)))
        out = seg if out is None else out.unionByName(seg)
    return trigram_index(docs, key, text) if out is None else out.select("file", "gram")


_SEGMENTS: dict[str, list[tuple[str, set[str]]]] = {}


def _manifest(spark, name: str) -> list[tuple[str, set[str]]]:
    """The segments that an earlier process has written, with their data files."""
    try:
        rows = spark.read.schema("segment string, file string").parquet(f"{name}/manifest").collect()  # a row for each data file
    except AnalysisException:
        return []
    out: dict[str, set[str]] = {}
    for r in rows:
        out.setdefault(r["segment"], set()).add(r["file"])
    return list(out.items())


def required(pattern: str) -> list | None:
    """What a match of the regex must hold, as nested ["and"|"or", ...] of literals of three characters or more.

    None: nothing is required.
    """
    from re import _parser as sre

    return _simplified(_walk(sre.parse(pattern)))


def _walk(nodes) -> list:
    parts: list = []
    run = ""
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            run += chr(arg).lower()
            continue
        if len(run) >= 3:
            parts.append(run)
        run = ""
        if name == "BRANCH":
            parts.append(["or", *[_walk(b) for b in arg[1]]])
        elif name == "SUBPATTERN":
            parts.append(_walk(arg[-1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            parts.append(_walk(arg[2]))
    if len(run) >= 3:
        parts.append(run)
    return ["and", *parts]


def _simplified(e):
    if isinstance(e, str):
        return e
    parts = [_simplified(x) for x in e[1:]]
    if e[0] == "or" and any(p is None for p in parts):
        return None
    parts = [p for p in parts if p is not None]
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else [e[0], *parts]


def grams_of(literal: str) -> list[str]:
    return sorted({literal[i : i + 3] for i in range(len(literal) - 2)})


def candidates(index: DataFrame, need) -> DataFrame:
    """(file) of the index that may hold what is needed: one aggregate over the posting lists, no join of lists."""

    def grams(e) -> set[str]:
        return set(grams_of(e)) if isinstance(e, str) else {g for x in e[1:] for g in grams(x)}

    every = sorted(grams(need))

    def test(e) -> Column:
        if isinstance(e, str):
            t = F.lit(True)
            for g in grams_of(e):
                t = t & F.array_contains("have", g)
            return t
        t = test(e[1])
        for x in e[2:]:
            t = (t & test(x)) if e[0] == "and" else (t | test(x))
        return t

    have = index.where(F.col("gram").isin(every)).groupBy("file").agg(F.collect_set("gram").alias("have"))
    return have.where(test(need)).select("file")


def indexed_sites(docs: DataFrame, key: str, lines_of, query: Query, index: DataFrame | None = None) -> DataFrame:
    """sites() over the lines of candidate documents alone; the same rows as without the index."""
    needs = [required(p) for p in query.patterns]
    if any(n is None for n in needs):
        return sites(lines_of(docs), query)
    index = trigram_index(docs, key) if index is None else index
    need = needs[0] if len(needs) == 1 else ["or", *needs]
    keep = docs.join(candidates(index, need), F.col(key).cast("string") == F.col("file"), "left_semi")
    return sites(lines_of(keep), query)
