"""7. Quality rules with risk-controlled thresholds.

Every rule is a number of a text (share of symbols, of repeated lines, ...) and rejects texts above a cutoff.  What is
controlled is that a text is rejected by any of the rules: in each stratum at most `risk` of the good texts.

1. On one half of the good labelled rows, dealt by a hash of doc_id, each rule of a stratum takes the lowest cutoff of its grid
   that rejects at most a share of risk / rules.  This only chooses; it promises nothing.
2. On the other half the chosen rules are tested together, by an exact binomial test of the texts that any of them rejects;
   if that fails, all cutoffs are loosened by one step of their grids, and so on, `STEPS` times.  The tests of all strata and steps
   share the error probability `delta` (Bonferroni), so all guarantees hold together with probability 1 - delta.

Good rows are labelled quality 1, and not 0 as well.  Texts that fail the base rules are rejected anyway and are left out of
the rates on both sides: the guarantee is about good texts that pass them.

Only DataFrame functions run on the executors.  The driver gets a row of counts for each stratum that has enough good rows
to show the risk at all; their number is checked (`MOST_STRATA`), since cutoffs are part of the plan.

Defined cases: a null text has no words; null labels and labels of unknown ids are not used; a stratum with too few
good labelled rows gets no cutoff (its rules never reject); a null stratum is the empty one; repeated rows each get their own
verdict, and count once each as labelled rows; a text's number that ties with a cutoff is not above it; a very long text is
taken whole, with memory in proportion to its length; an empty table gives an empty result.  Columns besides doc_id, text
and the stratum are ignored by `judge` and kept by `keep_good`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_columns_of, written

SPACE = "\\x20\\x09-\\x0D"
WINDOW = 8
#: Rule -> grid of cutoffs, low (strict) to high.  A text is rejected if its number is above the cutoff.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.02, 0.05, 0.1, 0.2, 0.4),
    "dup_line_share": (0.1, 0.2, 0.3, 0.5, 0.7),
    "repeat_share": (0.05, 0.1, 0.15, 0.2, 0.25),
    "mean_word": (7.0, 9.0, 11.0, 14.0, 20.0),
    "shout_share": (0.1, 0.2, 0.3, 0.5, 0.8),
}
RISK, DELTA, STEPS = 0.01, 0.05, 5
MOST_STRATA = 10_000
#: Ids up to this number are broadcast (8 bytes each); more are joined by a shuffle.
FEW_IDS = 2_000_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it many times."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, n: int = WINDOW) -> Column:
    """Words of an array that lie in runs of n words found at least twice in it."""

    def covered(runs: Column) -> Column:
        order = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def scan(s: Column) -> Column:
            same = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: a["h"] == b["h"])

            def places(e: Column) -> Column:
                no = F.array(F.lit(False))
                twice = F.zip_with(F.concat(no, e), F.concat(e, no), lambda a, b: a | b)
                at = F.zip_with(s, twice, lambda x, t: F.when(t, x["i"]))
                return F.array_sort(F.filter(at, lambda x: x.isNotNull()))

            def length(p: Column) -> Column:
                ends = F.concat(F.slice(p, 2, F.size(p) - 1), F.array(F.element_at(p, -1) + n))
                return F.aggregate(F.zip_with(p, ends, lambda a, b: F.least(F.lit(n), b - a)), F.lit(0), lambda x, y: x + y)

            return let(let(same, places), length)

        return let(order, scan)

    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (n - 1))), lambda i: F.xxhash64(F.slice(words, i, n)))
    found = let(runs, lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0)).otherwise(covered(r)))
    return F.when(F.size(words) <= n, F.lit(0)).otherwise(found).cast("long")


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of every whole text."""
    t = with_columns_of(docs, ("doc_id", "long"), ("text", "string"), (stratum, "string"))
    return t.select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), counts(F.coalesce("text", F.lit(""))).alias("c")).select("doc_id", "stratum", "c.*")


def counts(t: Column) -> Column:
    """The counts of a text as one struct.  Parts that are used more than once are bound, so none is computed twice."""
    words = F.filter(F.split(t, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))

    def made(x: Column) -> Column:
        w, y = x["w"], x["l"]
        without = lambda chars: F.length(F.translate(t, chars, ""))
        return F.struct(
            F.size(w).cast("long").alias("n_words"), without(" \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
            (F.length(t) - without("#*$%&|<>")).cast("long").alias("n_symbols"), (F.length(t) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"),
            F.size(y).cast("long").alias("n_lines"), (F.size(y) - F.size(F.array_distinct(y))).cast("long").alias("n_dup_lines"),
            let(w, lambda v: repeat_words(v)).alias("n_repeat_words"),
        )

    return let(F.struct(words.alias("w"), lines.alias("l")), made)


def rule_values(of=F.col) -> dict[str, Column]:
    some = lambda n, d: F.coalesce(of(n) / F.when(of(d) > 0, of(d)), F.lit(0.0))
    return {
        "symbol_share": some("n_symbols", "word_chars"),
        "dup_line_share": some("n_dup_lines", "n_lines"),
        "repeat_share": some("n_repeat_words", "n_words"),
        "mean_word": some("word_chars", "n_words"),
        "shout_share": some("n_upper", "word_chars"),
    }


def base_failed(of=F.col) -> Column:
    return (of("n_words") < 20) | (100 * of("n_repeat_words") > 30 * of("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for n trials of probability p."""
    if n == 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def controlled(k: int, n: int, risk: float, level: float) -> bool:
    """Is it shown at this level that fewer than `risk` of the good texts are rejected, k of n having been?"""
    return n > 0 and k <= risk * n and binomial_tail(k, n, risk) <= level


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the rows labelled quality 1 and not 0 as well."""
    known = with_columns_of(labels, ("doc_id", "long"), ("quality", "int")).where("doc_id is not null and quality is not null")
    return known.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("p")).where("q = 1 and p = 1").select("doc_id")


def cutoffs(feats: DataFrame, good: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> cutoff.  good holds the ids of good rows."""
    held = feats.join(good, "doc_id", "left_semi").where(~base_failed()).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)))
    values = rule_values()
    above = [F.sum((values[r] > c).cast("long")).alias(f"{r}@{i}") for r, grid in GRIDS.items() for i, c in enumerate(grid)]
    least = math.log(delta / STEPS) / math.log1p(-risk)  # fewer rows show nothing, even with no rejection and one stratum
    chosen = held.where("half = 0").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *above).where(F.col("n") >= least / 2).limit(MOST_STRATA + 1).collect()
    if len(chosen) > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata have enough labelled rows; group them first")
    first = {}
    for row in chosen:
        for rule, grid in GRIDS.items():
            fit = [i for i in range(len(grid)) if row[f"{rule}@{i}"] <= row["n"] * risk / len(GRIDS)]
            if fit:
                first[row["stratum"], rule] = fit[0]
    if not first:
        return {}
    steps = [loosened(first, k) for k in range(STEPS)]
    any_of = [F.sum(rejecting(cuts).isNotNull().cast("long")).alias(f"k{k}") for k, cuts in enumerate(steps)]
    tested = held.where("half = 1").where(F.col("stratum").isin(sorted({s for s, _ in first}))).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *any_of).collect()  # as many rows
    level = delta / max(1, len(tested) * STEPS)
    out = {}
    for row in tested:
        ok = [k for k in range(STEPS) if controlled(row[f"k{k}"], row["n"], risk, level)]
        if ok:
            out |= {key: c for key, c in steps[ok[0]].items() if key[0] == row["stratum"]}
    return out


def loosened(first: dict[tuple[str, str], int], k: int) -> dict[tuple[str, str], float]:
    """Cutoffs k steps of their grids above the chosen ones; a rule without such a step no longer rejects."""
    return {key: GRIDS[key[1]][i + k] for key, i in first.items() if i + k < len(GRIDS[key[1]])}


def rejecting(cuts: dict[tuple[str, str], float], of=F.col, stratum: Column | None = None) -> Column:
    """The first rule that rejects, or null."""
    values, rejects = rule_values(of), F.lit(None).cast("string")
    stratum = F.col("stratum") if stratum is None else stratum
    for rule in GRIDS:
        by = [x for (s, r), c in sorted(cuts.items()) if r == rule for x in (F.lit(s), F.lit(float(c)))]
        if by:
            rejects = F.coalesce(rejects, F.when(values[rule] > F.element_at(F.create_map(*by), stratum), F.lit(rule)))
    return rejects


def verdicts(feats: DataFrame, cuts: dict[tuple[str, str], float]) -> DataFrame:
    """feats with base_failed, kept and the first rule that rejects."""
    out = feats.withColumns({"base_failed": base_failed(), "rule": rejecting(cuts)})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """A row for each row of docs: its counts, base_failed, the rule that rejects it (or null) and kept."""
    feats = written(features(docs, stratum))
    return verdicts(feats, cutoffs(feats, good_ids(labels), risk, delta))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of docs that are kept, unchanged.  Counts are made of good labelled rows for the cutoffs, and of all to filter."""
    good = written(good_ids(labels))
    some = F.broadcast(good) if good.count() <= FEW_IDS else good
    cuts = cutoffs(written(features(docs.join(some, "doc_id", "left_semi"), stratum)), good, risk, delta)
    of = F.col(stratum).cast("string") if stratum in docs.columns else F.lit(None).cast("string")
    # one expression, so that the filter computes the counts of a text once
    kept = let(counts(F.coalesce(F.col("text").cast("string"), F.lit(""))), lambda c: ~base_failed(c.getField) & rejecting(cuts, c.getField, F.coalesce(of, F.lit(""))).isNull())
    return docs.where(kept)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
