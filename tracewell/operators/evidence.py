"""Evidence over files and lines: references, commits, outlines, candidates, focus, censuses, pages and bounded views."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import glob_regex
from ..sources import tables
from .search import Query


def references(docs: DataFrame, exact: DataFrame, symbol: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(file, line, engine) where a name is used: rows of an exact index (file, line, symbol), and for files that the index
    does not hold, lines with the name as a word.  A place counts once, exact rows first."""
    known = exact.select("file").distinct()
    of = docs.where(F.col(text).contains(symbol)).select(key, text)
    stale = of.join(known, F.col(key).cast("string") == F.col("file"), "left_anti")
    word = f"(?:^|[^A-Za-z0-9_]){re.escape(symbol)}(?:[^A-Za-z0-9_]|$)"
    loose = tables.lines(stale, key, text).where(F.col("text").rlike(word)).select("file", "line", F.lit("textual").alias("engine"))
    sure = exact.where(F.col("symbol") == symbol).select("file", "line", F.lit("exact").alias("engine"))
    return sure.unionByName(loose).groupBy("file", "line").agg(F.min("engine").alias("engine"))


def defining(decls: DataFrame, by: str = "kind") -> DataFrame:
    """(by, files, symbols): how many files define something of each kind."""
    return decls.groupBy(by).agg(F.countDistinct("file").alias("files"), F.countDistinct("symbol").alias("symbols"))


def commits(log: DataFrame, query: Query) -> DataFrame:
    """Commits (commit, at, author, text) that hold all patterns, after: and before: a date, by an author:, of a commit (rev:)."""
    test = F.lit(True)
    for p in query.patterns:
        test = test & F.col("text").rlike(p if query.exact_case else f"(?i){p}")
    for name, value, negated in query.filters:
        if name == "case":
            continue
        if name not in ("after", "before", "author", "rev"):
            raise ValueError(f"{name}: does not apply to commits")
        t = {"after": F.col("at") >= F.lit(value).cast("timestamp"), "before": F.col("at") < F.lit(value).cast("timestamp"), "author": F.col("author") == value, "rev": F.col("commit").cast("string") == value}[name]
        test = test & (~t if negated else t)
    return log.where(test)


def history(rows: DataFrame, commit_files: DataFrame, most: int = 24) -> tuple[DataFrame, DataFrame]:
    """Rows (file, ...) with the last commit (last_commit, last_at) of their file, for the first `most` files by name; and the
    count of the rows of others, which stay without one."""
    first = rows.select("file").distinct().orderBy("file").limit(most)
    last = commit_files.join(F.broadcast(first), "file", "left_semi").groupBy("file").agg(F.max(F.struct("at", "commit")).alias("_l"))  # `most` names
    gone = rows.join(first, "file", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(last, "file", "left").select(*rows.columns, F.col("_l.commit").alias("last_commit"), F.col("_l.at").alias("last_at")), gone


def outline(rows: DataFrame, decls: DataFrame, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """(file, line, text): the declarations of the first `most` files of rows, by name; and the count of the other files."""
    every = rows.select("file").distinct()
    first = every.orderBy("file").limit(most)
    gone = every.agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("n"))
    text = F.concat_ws(" ", "kind", "symbol")
    return decls.join(F.broadcast(first), "file", "left_semi").select("file", F.col("line_a").alias("line"), text.alias("text")), gone  # `most` names


def symbol_text(lines: DataFrame, decls: DataFrame, symbol: str) -> DataFrame:
    """(file, line, text) of the lines that a symbol's declarations span."""
    want = decls.where(F.col("symbol") == symbol).select("file", F.explode(F.sequence("line_a", "line_b")).alias("line")).distinct()
    return lines.join(want, ["file", "line"]).select("file", "line", "text")


def code_context(lines: DataFrame, sites: DataFrame, around: int, most: int = 60) -> DataFrame:
    """(file, first, last, text): a stretch of lines about each site, at most `most` lines, as one text."""
    stretch = sites.select("file", "line", F.greatest(F.col("line") - around, F.lit(1)).alias("first"), F.least(F.col("line") + around, F.greatest(F.col("line") - around, F.lit(1)) + most - 1).alias("last")).distinct()
    want = stretch.select("file", F.col("line").alias("at"), F.explode(F.sequence("first", "last")).alias("line"))
    g = lines.join(want, ["file", "line"]).groupBy("file", "at").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return g.select("file", "at", "first", "last", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def related_tests(files: DataFrame, tests: DataFrame) -> DataFrame:
    """(file, test, reason) of files (file, stem) and tests (test, name, text): named test_<stem> or <stem>_test, else with an
    import of the stem.  A test counts once for a file, its name first.  Names and imports are extracted, so joins are equal."""
    stem = F.regexp_extract("name", "^test_(.+)$|^(.+)_test$", 1)
    stem = F.when(stem != "", stem).otherwise(F.regexp_extract("name", "^(.+)_test$", 1))
    named = tests.select("test", stem.alias("stem"), F.lit("name").alias("reason")).where("stem <> ''")
    held = tests.select("test", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?:^|[^A-Za-z0-9_])import ([A-Za-z0-9_]+)"), 1))).alias("stem"), F.lit("text").alias("reason"))
    return named.unionByName(held).join(files, "stem").groupBy("file", "test").agg(F.min("reason").alias("reason"))


def candidates(causes: DataFrame) -> DataFrame:
    """(symbol, file, line, tests, n_tests, classes): what may have broken the tests of root causes, for each symbol and file."""
    g = causes.groupBy(F.coalesce("symbol", F.lit("(file-level)")).alias("symbol"), "file")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return g.agg(F.min("line").alias("line"), F.countDistinct("test").alias("n_tests"), joined("test").alias("tests"), joined("failure_class").alias("classes"))


def candidate_order() -> list[Column]:
    """The most tests first, then symbols before whole files, then by place."""
    return [F.desc("n_tests"), (F.col("symbol") == "(file-level)").cast("int"), F.col("file"), F.col("line"), F.col("symbol")]


def realized(steps: DataFrame, provides: DataFrame) -> DataFrame:
    """(dimension, coverage) of steps (op, rows) and provides (op, dimension, share): operators with rows, each once, 1 at most."""
    ops = steps.where("rows >= 1").select("op").distinct()
    return ops.join(provides, "op").groupBy("dimension").agg(F.least(F.lit(1.0), F.sum("share")).alias("coverage"))


def focused(lines: DataFrame, terms: list[str], rank: Column, most: int = 4, kept: int = 2) -> DataFrame:
    """(file, line, why): at most `most` lines of each file: those with most of the terms, the earlier of equals; `kept` places are
    for other lines with a signal, the strongest first, if there are any."""
    low = F.lower("text")
    hits = sum((low.contains(t.lower()).cast("int") for t in terms[1:]), low.contains(terms[0].lower()).cast("int"))
    rows = lines.select("file", "line", hits.alias("hits"), rank.alias("rank")).where("hits > 0 or rank > 0")
    other = F.col("hits") == 0
    place = lambda c, *o: F.row_number().over(Window.partitionBy("file", c).orderBy(*o))
    rows = rows.withColumn("other", other)
    rows = rows.withColumn("place", F.when(F.col("other"), place("other", F.desc("rank"), "line")).otherwise(place("other", F.desc("hits"), "line")))
    spare = rows.groupBy("file").agg(F.least(F.lit(kept), F.sum(F.col("other").cast("int"))).alias("spare"))
    rows = rows.where(F.col("place") <= most).join(spare, "file")
    fits = F.when(F.col("other"), F.col("place") <= kept).otherwise(F.col("place") <= most - F.col("spare"))
    return rows.where(fits).select("file", "line", F.when(F.col("other"), "signal").otherwise("focus").alias("why"))


def message_order(found: DataFrame) -> list[Column]:
    """The order of messages (focus, tier, n, last, first, key): what is asked for, strong, rare and late comes first."""
    return [F.desc("focus"), F.desc("tier"), F.col("n"), F.desc("last"), F.col("first"), F.col("key")]


def search_census(hits: DataFrame, definition: str, dispersed: int = 12) -> DataFrame:
    """(matches, files, definitions, structural): is a search about structure, so that half of its hits (three at least) define
    something, or spread over many files?"""
    g = hits.agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("file").alias("files"), F.coalesce(F.sum(F.col("text").rlike(definition).cast("long")), F.lit(0)).alias("definitions"))
    half = F.greatest(F.lit(3), F.floor(F.col("matches") / 2))
    return g.withColumn("structural", (F.col("definitions") >= half) | (F.col("files") >= dispersed))


def within_budget(lines: DataFrame, room: int) -> DataFrame:
    """(file, shown, used, next_line): the lines of each file that fit into `room` bytes, cut at a line's end, and where to go on."""
    by = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("used", F.sum(F.octet_length("text") + 1).over(by))
    fits = F.col("used") <= room
    return rows.groupBy("file").agg(
        F.sum(fits.cast("long")).alias("shown"), F.coalesce(F.max(F.when(fits, F.col("used"))), F.lit(0)).cast("long").alias("used"), F.min(F.when(~fits, F.col("line"))).alias("next_line")
    )


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of a total order, with the place of each row; no more than the pages up to it are sorted."""
    first = rows.orderBy(*order).limit(number * size)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") > (number - 1) * size)  # of number * size rows


def zoom(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """(file, first, last, half, a, b, lines, bytes): the two halves of regions (file, first, last), with what they hold."""
    mid = F.floor((F.col("first") + F.col("last")) / 2)
    halves = F.array(F.struct(F.lit(1).alias("half"), F.col("first").alias("a"), mid.alias("b")), F.struct(F.lit(2).alias("half"), (mid + 1).alias("a"), F.col("last").alias("b")))
    spans = regions.select("file", "first", "last", F.explode(halves).alias("h")).select("file", "first", "last", "h.*").where("a <= b")
    want = spans.select("*", F.explode(F.sequence("a", "b")).alias("line"))
    g = want.join(lines, ["file", "line"]).groupBy("file", "first", "last", "half", "a", "b")
    return g.agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("text")).cast("long").alias("bytes")).withColumn("half", F.col("half").cast("long"))


def capped(lines: DataFrame, room: int) -> DataFrame:
    """(file, line, text, part): the first and the last lines of a stream, half of `room` bytes each, in their own numbers."""
    size = F.octet_length("text") + 1
    ahead = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("file").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumns({"_a": F.sum(size).over(ahead), "_b": F.sum(size).over(back)})
    part = F.when(F.col("_a") <= room // 2, "head").when(F.col("_b") <= room // 2, "tail")
    return rows.withColumn("part", part).where("part is not null").select("file", "line", "text", "part")


def capped_digest(lines: DataFrame, room: int) -> DataFrame:
    """(file, lines, bytes, kept_lines, kept_bytes, last_head, first_tail): exact counts of what `capped` keeps and drops."""
    size = (F.octet_length("text") + 1).cast("long")
    total = lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum(size).alias("bytes"))
    kept = capped(lines, room).groupBy("file").agg(
        F.count(F.lit(1)).alias("kept_lines"), F.sum(size).alias("kept_bytes"), F.max(F.when(F.col("part") == "head", F.col("line"))).alias("last_head"), F.min(F.when(F.col("part") == "tail", F.col("line"))).alias("first_tail")
    )
    out = total.join(kept, "file", "left")
    return out.select("file", "lines", "bytes", F.coalesce("kept_lines", F.lit(0)).alias("kept_lines"), F.coalesce("kept_bytes", F.lit(0)).alias("kept_bytes"), "last_head", "first_tail")


def intake(blobs: DataFrame, data: str = "data") -> DataFrame:
    """Blobs with kind (utf-16, binary or text) and text: UTF-16 by its mark, binary by a zero byte in the first 8 KiB."""
    head = F.hex(F.substring(data, 1, 2))
    zero = F.hex(F.substring(data, 1, 8192)).rlike("^(?:..)*?00")
    kind = F.when(head.isin("FFFE", "FEFF"), "utf-16").when(zero, "binary").otherwise("text")
    return blobs.withColumn("kind", kind).withColumn("text", F.when(F.col("kind") == "utf-16", F.decode(data, "UTF-16")).when(F.col("kind") == "text", F.decode(data, "UTF-8")))


def text_shape(lines: DataFrame, level: str, head: int = 200, least: int = 80, share: int = 40) -> DataFrame:
    """(file, lines, levels, shape): a log if `share` % of the first `head` lines that hold anything, `least` of them, have a level."""
    rows = lines.where(F.col("text").rlike("[^ \\t\\r]"))
    by = Window.partitionBy("file").orderBy("line")
    rows = rows.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= head)
    g = rows.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("text").rlike(level).cast("long")).alias("levels"))
    return g.withColumn("shape", F.when((F.col("lines") >= least) & (F.col("levels") * 100 >= share * F.col("lines")), "log").otherwise("prose"))


def field_counts(rows: DataFrame, delimiter: str) -> DataFrame:
    """(rows, blank, fewest, most, usual, ragged) of rows (line): lines whose number of fields is not the usual one are ragged."""
    n = F.size(F.split("line", f"[{delimiter}]", -1))
    by = rows.groupBy(F.when(F.trim("line") == "", None).otherwise(n).cast("long").alias("fields")).agg(F.count(F.lit(1)).alias("n"))
    some = F.col("fields").isNotNull()
    g = by.agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).alias("blank"), F.min("fields").alias("fewest"), F.max("fields").alias("most"),
        F.max(F.when(some, F.struct("n", "fields"))).alias("u"), F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("filled"),
    )
    return g.select("rows", "blank", "fewest", "most", F.col("u.fields").alias("usual"), (F.col("filled") - F.col("u.n")).alias("ragged"))


def data_shape(cells: DataFrame, most: int = 16, share: int = 60) -> DataFrame:
    """(column, cells, numbers, numeric) of cells (column, cell), for the first `most` columns by name: numeric if `share` % are numbers."""
    g = cells.groupBy("column").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.coalesce(F.trim("cell").rlike("^[+-]?[0-9]+([.][0-9]*)?$"), F.lit(False)).cast("long")).alias("numbers"))
    return g.orderBy("column").limit(most).withColumn("numeric", F.col("numbers") * 100 >= share * F.col("cells"))


def majority(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, n): the most frequent value of each key, the first by name of equals."""
    n = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")).select(by, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def all_but_last(rows: DataFrame, key: str, order: list[Column], keep: int, cost: str, least: float) -> DataFrame:
    """Rows beyond the last `keep` of each key that cost `least` or more."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where((F.col("_r") > keep) & (F.col(cost) >= least)).drop("_r")


def prefix_counts(lines: DataFrame) -> DataFrame:
    """(file, path, adds, dels) of git diffs as lines (file, line, text): + and - lines of each diffed file, its headers left out."""
    by = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = F.when(F.col("text").startswith("diff --git "), F.regexp_extract("text", " b/(.*)$", 1))
    rows = lines.withColumn("path", F.last(path, ignorenulls=True).over(by)).where("path is not null")
    n = lambda c: F.sum((F.col("text").startswith(c) & ~F.col("text").startswith(c * 3)).cast("long"))
    return rows.groupBy("file", "path").agg(n("+").alias("adds"), n("-").alias("dels"))


def scored(rows: DataFrame, score: Column, least: float, most: int, order: list[Column]) -> DataFrame:
    """Rows with a score of `least` or more, the `most` best; where a scorer gives nothing (null), the row stays, at `least`."""
    return rows.withColumn("score", F.coalesce(score.cast("double"), F.lit(float(least)))).where(F.col("score") >= least).orderBy(F.desc("score"), *order).limit(most)


def user_script(rows: DataFrame, script, schema: str) -> DataFrame:
    """A user's function over batches of rows (pandas frames in, pandas frames out)."""
    return rows.mapInPandas(lambda batches: (out for b in batches if len(out := script(b))), schema)


class Profiles:
    """Profiles of texts in a fixed order of probing: the first whose test holds extracts; `prose` is the last."""

    def __init__(self):
        self.known: list[tuple[str, Column, Column]] = []

    def register(self, name: str, detect: Column, extract: Column) -> None:
        if any(n == name for n, _, _ in self.known):
            raise ValueError(f"profile {name} is registered already")
        self.known.append((name, detect, extract))

    def apply(self, texts: DataFrame) -> DataFrame:
        """texts with profile and found (a string of what was extracted)."""
        name, found = F.lit("prose"), F.lit(None).cast("string")
        for n, detect, extract in reversed(self.known):
            name, found = F.when(detect, n).otherwise(name), F.when(detect, extract.cast("string")).otherwise(found)
        return texts.withColumns({"profile": name, "found": found})


def files_like(files: DataFrame, glob: str, allowance: int) -> tuple[DataFrame, DataFrame]:
    """Evidence discovery: the first `allowance` files (file, size) that fit a glob, by name, and the count of the others."""
    fit = files.where(F.col("file").rlike(glob_regex(glob)))
    return fit.orderBy("file").limit(allowance), fit.agg(F.greatest(F.count(F.lit(1)) - allowance, F.lit(0)).alias("n"))


def literal_hits(docs: DataFrame, literal: str, allowance: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Evidence search: the first `allowance` lines (file, line, col) that hold a literal, by place."""
    rows = tables.lines(docs.where(F.col(text).contains(literal)), key, text)
    hits = rows.select("file", "line", F.instr("text", literal).cast("long").alias("col")).where("col > 0")
    return hits.orderBy("file", "line").limit(allowance)
