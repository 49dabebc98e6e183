import math
import re
from collections import Counter

from tracewell.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def texts():
    a = "one two three four five six seven eight nine"
    return [None, "", " \n\t", a, a + " " + a, a + "\n" + a + "\n" + a, "x " * 40, "x " * 8, "x " * 9, "# * $ <b> é\u3000ü\n\n \n#\n#", "\x0bq\x0cr\rs", " ".join(str(i % 11) for i in range(300)) + " end"]


def test_counts_match_brute_force(spark, hard):
    rows = [(i, t, "en") for i, t in enumerate(texts() + [r["text"] for r in hard.collect()])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in Q.features(docs).collect()}
    assert got == {i: brute(t) for i, t, _ in rows}


def test_exact_binomial_bound():
    for n, k, p in ((10, 0, 0.3), (50, 3, 0.1), (400, 0, 0.01)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(Q.binomial_tail(k, n, p) - want) < 1e-9
    assert Q.controlled(0, 500, 0.01, 0.01) and not Q.controlled(0, 100, 0.01, 0.01) and not Q.controlled(50, 500, 0.01, 0.5)


def test_cutoffs_hold_the_risk_and_bad_texts_go(spark):
    good = "The first line of it says one thing after another and the next says more of the same, plainly and well number {}."
    rows = [(i, (good.format(i) + " ") * 1 + f"and {i} and {i + 1} and so on it goes", "en") for i in range(2500)]
    rows += [(10_000 + i, " ".join(f"w{i}x{j}#*$" for j in range(60)), "en") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2500)] + [(10_000 + i, 0, 0) for i in range(25)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in Q.judge(docs, labels).collect()}
    assert sum(not out[i]["kept"] for i in range(2500)) <= 25
    assert not any(out[10_000 + i]["kept"] for i in range(50))
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["kept"]}


def test_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, None), (2, None, None)], "doc_id long, quality int, toxic int")
    rows = Q.judge(hard, labels).collect()
    assert len(rows) == hard.count()
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in rows)
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert Q.judge(empty, labels).collect() == [] and Q.keep_good(hard, labels).columns == hard.columns


def test_five_independent_rules_together_hold_the_risk(spark):
    """Good texts of which each rule would reject 0.8 %: one rule alone is within the risk, all five are not."""
    import random

    r, rates = random.Random(3), []
    for trial in range(6):
        rows = []
        for i in range(20_000):
            off = [r.random() < 0.008 for _ in range(5)]
            chars = 500
            rows.append((i, "en", 100, 1900 if off[3] else chars, int(chars * 0.9) * 4 if off[0] else 0, int(0.95 * (1900 if off[3] else chars)) if off[4] else 0, 20, 19 if off[1] else 0, 27 if off[2] else 0))
        feats = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_upper long, n_lines long, n_dup_lines long, n_repeat_words long")
        cuts = Q.cutoffs(feats, feats.select("doc_id"))
        out = Q.verdicts(feats, cuts)
        rates.append(out.where("not kept").count() / len(rows))
    assert max(rates) <= 0.01, rates


def test_labels_of_both_kinds_are_not_good(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, None), (3, 1), (None, 1), (4, 0)], "doc_id long, quality int")
    assert sorted(x["doc_id"] for x in Q.good_ids(labels).collect()) == [2, 3]
