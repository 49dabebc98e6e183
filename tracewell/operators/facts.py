"""Joins over facts: decl, imp, fail and changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_of(fails: DataFrame, run: str) -> DataFrame:
    """The failures of one run; `last` is the newest."""
    if run != "last":
        return fails.where(F.col("run_id") == int(run))
    newest = fails.agg(F.max("run_id").alias("_r"))
    return fails.join(F.broadcast(newest), F.col("run_id") == F.col("_r")).drop("_r")  # one row


def named(decls: DataFrame, symbol: str) -> DataFrame:
    """Declarations of a name: exact, or equal after a dot on either side."""
    s = F.col("symbol")
    return decls.where((s == symbol) | s.endswith("." + symbol) | F.lit(symbol).endswith(F.concat(F.lit("."), s)))


def innermost(sites: DataFrame, decls: DataFrame) -> DataFrame:
    """Sites that lie in a declaration of their file, with the innermost one: shortest, then latest start, then name.

    The interval join runs on (file, block of lines), so that a file's sites meet only declarations near them.  Equal sites
    are one.
    """
    block = 64
    d = decls.select("file", "symbol", "line_a", "line_b", F.explode(F.sequence(F.floor(F.col("line_a") / block), F.floor(F.col("line_b") / block))).alias("_b"))
    s = sites.withColumn("_b", F.floor(F.col("line") / block))
    inside = s.join(d, ["file", "_b"]).where((F.col("line_a") <= F.col("line")) & (F.col("line") <= F.col("line_b")))
    best = F.struct((F.col("line_b") - F.col("line_a")).alias("w"), (-F.col("line_a")).alias("a"), "symbol")
    return inside.groupBy(*sites.columns).agg(F.min(best).alias("_d")).select(*sites.columns, F.col("_d.symbol").alias("symbol"))


def root_cause(fails: DataFrame, changed: DataFrame, decls: DataFrame, generation: str) -> DataFrame:
    """Failures in changed files with the innermost declaration (precision `symbol`), or, where the file has no
    declarations at all, as they are (precision `file`).  A failure outside all of its file's declarations is left out."""
    touched = changed.where(F.col("generation") == generation).select("file").distinct()
    here = fails.join(touched, "file", "left_semi")
    found = innermost(here, decls).withColumn("precision", F.lit("symbol"))
    bare = here.join(decls.select("file").distinct(), "file", "left_anti")
    bare = bare.withColumns({"symbol": F.lit(None).cast("string"), "precision": F.lit("file")})
    return found.unionByName(bare)


def untouched(fails: DataFrame, changed: DataFrame, generation: str) -> DataFrame:
    """Failures in files that did not change; none if the generation is unknown."""
    known = changed.where(F.col("generation") == generation)
    return fails.join(known.select("file").distinct(), "file", "left_anti").join(F.broadcast(known.select(F.lit(1).alias("_k")).limit(1)), how="cross").drop("_k")


def shared_class(fails: DataFrame, least: int = 2) -> DataFrame:
    """(file, failure_class, n, tests) of at least two tests."""
    g = fails.groupBy("file", F.coalesce("failure_class", F.lit("?")).alias("failure_class"))
    return g.agg(F.countDistinct("test").alias("n"), F.array_join(F.array_sort(F.collect_set("test")), ",").alias("tests")).where(F.col("n") >= least)


def shared_cause(fails: DataFrame, decls: DataFrame) -> DataFrame:
    """Groups of at least two tests by (file, class) and by (file, innermost symbol)."""
    by_class = shared_class(fails).select(F.lit("class").alias("axis"), "file", F.col("failure_class").alias("key"), "n", "tests")
    g = innermost(fails, decls).groupBy("file", "symbol")
    by_symbol = g.agg(F.countDistinct("test").alias("n"), F.array_join(F.array_sort(F.collect_set("test")), ",").alias("tests")).where("n >= 2")
    return by_class.unionByName(by_symbol.select(F.lit("symbol").alias("axis"), "file", F.col("symbol").alias("key"), "n", "tests"))


def in_changed(sites: DataFrame, changed: DataFrame, decls: DataFrame, generation: str) -> DataFrame:
    """Sites in changed files, with the innermost declaration where there is one."""
    touched = changed.where(F.col("generation") == generation).select("file").distinct()
    here = sites.join(touched, "file", "left_semi")
    keys = [c for c in here.columns if c in ("test", "file", "line", "col_a")]
    inner = innermost(here.select(*keys), decls)
    return here.join(inner.select(*keys, "symbol"), keys, "left")


def neighbors(decls: DataFrame, imports: DataFrame, symbol: str) -> DataFrame:
    """What stands beside a symbol: importers of its module, modules its file imports, siblings of its file.

    An import names a module by stem or dotted path; suffixes of the dotted name are exploded for an equi-join.
    """
    own = decls.where(F.col("symbol") == symbol).select("file").distinct()
    parts = F.split("module", "[.]")
    tails = imports.select("file", "module", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("tail"))
    importers = tails.join(own.select(F.col("file").alias("tail")), "tail", "left_semi").select(F.lit("imported-by").alias("relation"), F.col("file").alias("name"))
    imported = imports.join(own, "file", "left_semi").select(F.lit("imports").alias("relation"), F.col("module").alias("name"))
    siblings = decls.join(own, "file", "left_semi").where(F.col("symbol") != symbol).select(F.lit("sibling").alias("relation"), F.col("symbol").alias("name"))
    return importers.unionByName(imported).unionByName(siblings).distinct()


def best_tier(calls: DataFrame, targets: DataFrame, tier: Column) -> DataFrame:
    """Each call with all targets of its best tier: ties stay."""
    both = calls.join(targets, "name").withColumn("tier", tier)
    best = both.groupBy("call").agg(F.min("tier").alias("tier"))
    return both.join(best, ["call", "tier"])


def longest_prefix(names: DataFrame, modules: DataFrame) -> DataFrame:
    """(name, module): the longest module that is a dotted prefix of a name."""
    parts = F.split("name", "[.]")
    heads = names.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).alias("module"))
    return heads.join(modules.select("module").distinct(), "module").groupBy("name").agg(F.max_by("module", F.length("module")).alias("module"))


def failure_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one run has, as `resolved` or `new`."""
    b, a = before.select(*key).distinct(), after.select(*key).distinct()
    gone = b.join(a, key, "left_anti").withColumn("change", F.lit("resolved"))
    return gone.unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("new")))


def template_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Templates of two runs that only one has, or whose counts differ more than twofold."""
    both = a.toDF("template", "a").join(b.toDF("template", "b"), "template", "full_outer")
    both = both.select("template", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    change = F.when(F.col("a") == 0, "only-b").when(F.col("b") == 0, "only-a").when((F.col("a") > 2 * F.col("b")) | (F.col("b") > 2 * F.col("a")), "shift")
    return both.withColumn("change", change).where("change is not null")


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*").select(*df.columns)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the latest value of right at or before `at` in the same key: one union, no pairs."""
    cols = [c for c in left.columns if c not in (key, at)]
    a = left.select(key, at, F.lit(1).alias("_side"), F.struct(*cols).alias("_row"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"))
    b = right.select(key, at, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    by = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(b).withColumn(value, F.last("_v", ignorenulls=True).over(by)).where("_side = 1").select(key, at, "_row.*", value)
