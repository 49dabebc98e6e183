"""Profiles of text tables: templates, messages and slots, delimited and JSON columns, censuses, chunks, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import template, tokens

# Kinds of cells and the share that a column's kind must reach.
KIND_TESTS = (
    ("int", "^[+-]?[0-9]+$"),
    ("float", "^[+-]?([0-9]+[.][0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"),
    ("date", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("datetime", "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"),
    ("bool", "^(?i)(true|false|yes|no)$"),
)
CONSISTENT = 95


def templates(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(template, n, first_line) of the lines that hold anything."""
    rows = lines.where(F.col("text").rlike("[^ \\t\\r\\n\\f\\x0B]")).withColumn("template", template(F.col("text")))
    return rows.groupBy(*(by or []), "template").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "line")).alias("first")).select(*(by or []), "template", "n", F.col("first.file").alias("first_file"), F.col("first.line").alias("first_line"))


def exceptional(lines: DataFrame, most: int = 2) -> DataFrame:
    """Lines whose template occurs at most `most` times in their file."""
    rows = lines.where(F.col("text").rlike("[^ \\t\\r\\n\\f\\x0B]")).withColumn("template", template(F.col("text")))
    few = rows.groupBy("file", "template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
    return rows.join(few, ["file", "template"]).select("file", "line", "text", "n")


def slots(lines: DataFrame) -> DataFrame:
    """Lines with their skeleton (tokens without digits, quotes, slashes and the like) and the other tokens as slots."""
    t = tokens(F.col("text"))
    open_ = "[0-9/'\"`@=]"
    skeleton = F.array_join(F.transform(t, lambda x: F.when(x.rlike(open_), F.lit("<*>")).otherwise(x)), " ")
    return lines.withColumns({"skeleton": skeleton, "values": F.filter(t, lambda x: x.rlike(open_))})


def messages(lines: DataFrame, most: int = 8) -> DataFrame:
    """(skeleton, split, n, first_line): lines grouped by skeleton and by the slots that split it.

    A slot splits if it has at most `most` values and fewer than lines (or there are two lines at most).  One pass counts
    the values of each slot, one groups.
    """
    rows = slots(lines)
    each = rows.select("skeleton", F.posexplode("values").alias("slot", "value"))
    size = rows.groupBy("skeleton").agg(F.count(F.lit(1)).alias("lines"))
    found = each.groupBy("skeleton", "slot").agg(F.countDistinct("value").alias("d")).join(size, "skeleton")
    splits = found.where((F.col("d") <= most) & ((F.col("d") < F.col("lines")) | (F.col("lines") <= 2))).groupBy("skeleton").agg(F.array_sort(F.collect_set("slot")).alias("by"))
    rows = rows.join(splits, "skeleton", "left")
    key = F.array_join(F.coalesce(F.transform("by", lambda i: F.col("values")[i]), F.array().cast("array<string>")), "|")
    return rows.withColumn("split", key).groupBy("skeleton", "split").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "line")).alias("f")).select("skeleton", "split", "n", F.col("f.file").alias("first_file"), F.col("f.line").alias("first_line"))


def slot_values(lines: DataFrame) -> DataFrame:
    """(skeleton, slot, distinct values, lowest, highest): the census of each slot."""
    each = slots(lines).select("skeleton", F.posexplode("values").alias("slot", "value"))
    return each.groupBy("skeleton", "slot").agg(F.countDistinct("value").alias("n_values"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n")).withColumn("slot", F.col("slot").cast("long"))


def cell_kind(cell: Column) -> Column:
    c = F.trim(cell)
    kind = F.lit("text")
    for name, test in reversed(KIND_TESTS):
        kind = F.when(c.rlike(test), name).otherwise(kind)
    return F.when(F.coalesce(c, F.lit("")) == "", "empty").otherwise(kind)


def delimited(rows: DataFrame, delimiter: str, names: list[str]) -> DataFrame:
    """rows(line) of delimited text -> (column, kind, cells, empty, distinct, lo, hi, longest) of each column."""
    cells = rows.select(F.posexplode(F.split("line", f"[{delimiter}]", -1)).alias("i", "cell"))
    return columns(cells.select(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("i") + 1).cast("int")).alias("column"), "cell"))


def columns(cells: DataFrame) -> DataFrame:
    """cells(column, cell) -> a profile of each column; the kind is the narrowest that 95 % of its filled cells have."""
    k = cells.withColumn("kind", cell_kind(F.col("cell")))
    n = lambda *kinds: F.sum(F.col("kind").isin(*kinds).cast("long"))
    full = F.sum((F.col("kind") != "empty").cast("long"))
    share = lambda *kinds: n(*kinds) * 100 >= CONSISTENT * full
    kind = (
        F.when(full == 0, "empty").when(share("int"), "int").when(share("int", "float"), "float").when(share("date"), "date")
        .when(share("date", "datetime"), "datetime").when(share("bool"), "bool").otherwise("text")
    )
    filled = F.when(F.col("kind") != "empty", F.trim("cell"))
    return k.groupBy("column").agg(
        kind.alias("kind"), F.count(F.lit(1)).alias("cells"), n("empty").alias("empty"), F.countDistinct(filled).alias("distinct_values"),
        F.min(filled).alias("lo"), F.max(filled).alias("hi"), F.max(F.length(filled)).cast("long").alias("longest"),
    )


def sniff(head: list[str]) -> str | None:
    """The delimiter of a sample of lines: most lines have the same number of fields, two at least; more fields win."""
    best = None
    for d in ",\t;|":
        counts = [line.count(d) + 1 for line in head if line.strip()]
        if len(counts) < 5:
            return None
        mode = max(set(counts), key=lambda c: (counts.count(c), c))
        share = counts.count(mode) / len(counts)
        if mode > 1 and share * 100 >= CONSISTENT and (best is None or (share, mode) > best[:2]):
            best = (share, mode, d)
    return best[2] if best else None


def json_keys(records: DataFrame, json: str) -> DataFrame:
    """(key, n): how many records have each top-level key."""
    keys = F.json_object_keys(json)
    return records.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def json_shape(records: DataFrame, json: str) -> DataFrame:
    """(shape): one schema that fits all records."""
    return records.agg(F.schema_of_variant_agg(F.try_parse_json(json)).alias("shape"))


def pointer(json: Column, path: str) -> Column:
    """The text that an RFC 6901 pointer names; null where there is none."""
    if path and not path.startswith("/"):
        raise ValueError(f"a pointer begins with /: {path}")
    steps = [s.replace("~1", "/").replace("~0", "~") for s in path.split("/")[1:]]
    # numbers index arrays; an object key of digits is reached by its name in the map of the object
    spark_path = "$" + "".join(f"[{s}]" if s.isdigit() and (s == "0" or s[0] != "0") else "['" + s.replace("'", "\\'") + "']" for s in steps)
    return F.try_variant_get(F.try_parse_json(json), spark_path, "string")


def table_census(cells: DataFrame, rows: int, most: int = 8) -> DataFrame:
    """(column, value, n) of the columns with 2 to `most` values, a third of the rows at most."""
    v = cells.groupBy("column", "cell").agg(F.count(F.lit(1)).alias("n"))
    few = v.groupBy("column").agg(F.count(F.lit(1)).alias("d")).where((F.col("d") >= 2) & (F.col("d") <= most) & (F.col("d") * 3 <= rows))
    return v.join(few.select("column"), "column", "left_semi").withColumnRenamed("cell", "value")


def head_tail(lines: DataFrame, n: int) -> DataFrame:
    """The first and last n lines of each file, and how many lie between them.  A file's length is an aggregate."""
    size = lines.groupBy("file").agg(F.max("line").alias("total"))
    rows = lines.join(size, "file").where((F.col("line") <= n) | (F.col("line") > F.col("total") - n))
    return rows.withColumn("hidden", F.greatest(F.col("total") - 2 * n, F.lit(0)))


def chunk_best(lines: DataFrame, rank: Column, size: int) -> DataFrame:
    """(file, chunk, first, last, line, rank): the strongest line of each chunk, the latest of equals."""
    c = lines.withColumns({"chunk": F.floor((F.col("line") - 1) / size), "rank": rank})
    return c.groupBy("file", "chunk").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.max(F.struct("rank", "line")).alias("b")).select("file", "chunk", "first", "last", F.col("b.line").alias("line"), F.col("b.rank").cast("long").alias("rank"))


def anchors(lines: DataFrame, size: int) -> DataFrame:
    """(file, line, anchor): a hash of the `size` lines from each on."""
    h = lines.select("file", "line", F.substring(F.sha2("text", 256), 1, 16).alias("h"))
    by = Window.partitionBy("file").orderBy("line").rowsBetween(0, size - 1)
    w = h.withColumn("hs", F.collect_list("h").over(by)).where(F.size("hs") == size)
    return w.select("file", "line", F.substring(F.sha2(F.array_join("hs", ""), 256), 1, 8).alias("anchor"))


def relocate(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """wanted(file, line, anchor) with the nearest line of the same anchor, the earlier of two: verified, moved or refused."""
    both = wanted.join(found.select("file", "anchor", F.col("line").alias("at")), ["file", "anchor"], "left")
    best = both.groupBy("file", "line", "anchor").agg(F.min(F.struct(F.abs(F.col("at") - F.col("line")).alias("d"), "at")).alias("b"))
    status = F.when(F.col("b.at").isNull(), "refused").when(F.col("b.d") == 0, "verified").otherwise("moved")
    return best.select("file", "line", F.col("b.at").alias("at"), status.alias("status"))


def regions(numbers: DataFrame, gap: int = 2) -> DataFrame:
    """(path, first, last): numbers(path, n) as spans, those at most `gap` apart joined."""
    by = Window.partitionBy("path").orderBy("n")
    rows = numbers.distinct().withColumn("new", F.when(F.col("n") - F.lag("n").over(by) <= gap, 0).otherwise(1))
    return rows.withColumn("span", F.sum("new").over(by)).groupBy("path", "span").agg(F.min("n").alias("first"), F.max("n").alias("last")).drop("span")


def overlap(found: DataFrame, gold: DataFrame) -> DataFrame:
    """(path, found, gold, shared, precision, recall, f1) of line sets; 0 where a set is empty."""
    f, g = found.select("path", "n").distinct().withColumn("f", F.lit(1)), gold.select("path", "n").distinct().withColumn("g", F.lit(1))
    both = f.join(g, ["path", "n"], "full_outer").groupBy("path").agg(F.count("f").alias("found"), F.count("g").alias("gold"), F.count(F.when(F.col("f").isNotNull() & F.col("g").isNotNull(), 1)).alias("shared"))
    p = F.when(F.col("found") > 0, F.col("shared") / F.col("found")).otherwise(0.0)
    r = F.when(F.col("gold") > 0, F.col("shared") / F.col("gold")).otherwise(0.0)
    return both.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("shared") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def fill_forward(lines: DataFrame, mark: Column, value: Column) -> DataFrame:
    """Lines with the value of the last marked line at or before them in their file."""
    by = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("owner", F.last(F.when(mark, value), ignorenulls=True).over(by))


def decimated(rows: DataFrame, key: str, cap: int) -> DataFrame:
    """Every 2^k-th row by a running number, with the least k that leaves at most 2 * cap rows; for one bounded sample."""
    n = rows.count()
    stride = 1
    while -(-n // stride) > 2 * cap:
        stride *= 2
    return rows.where(F.pmod(F.col(key), F.lit(stride)) == 0)


