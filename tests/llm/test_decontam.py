import hashlib
import re
from collections import Counter

import pytest

from tracewell.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        x = words(t)
        n = min(13, len(x))
        for a in range(len(x) - n + 1 if n else 0):
            for b in range(len(w) - n + 1):
                if w[b : b + n] == x[a : a + n]:
                    hit |= set(range(b, b + n))
                    found.add(i or "")
    key = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), key, len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [10**6, 40])
def test_hits_match_brute_force(spark, hard, block):
    rows = hard.collect()
    long = next(r["text"] for r in rows if r["text"] and len(words(r["text"])) > 1000)
    items = [("1", rows[0]["text"]), ("2", " ".join(long.split(" ")[100:160])), ("3", "x"), ("10", "The, changed!"), ("4", None), ("5", ""), (None, " ".join(long.split(" ")[300:314])), ("2", "re")]
    items += [("9", " ".join(long.split(" ")[140:180])), ("8", rows[1]["text"])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = D.report(D.scan(hard.select("doc_id", "text"), bench, block_words=block)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = Counter((r["doc_id"], *brute(r["text"], items)) for r in rows)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_dropped_rows_and_columns(spark, hard, empty):
    bench = spark.createDataFrame([("1", "nothing like it")], "item_id string, text string")
    assert sorted(map(str, D.drop_contaminated(hard, bench).collect())) == sorted(map(str, hard.collect()))
    assert D.drop_contaminated(empty, bench).collect() == []
    assert D.drop_contaminated(hard, bench.limit(0)).columns == hard.columns


def test_passages_are_cut_from_kept_rows(spark):
    one, two = " ".join(f"i{k}" for k in range(200)), "Ünder a; B c d e f g h i j k, l m n o"
    fill = lambda n, x: " ".join(f"{x}{k}" for k in range(n))
    texts = {
        1: f"{fill(9000, 'a')}. {one}! {fill(9000, 'b')}", 2: f"{fill(100, 'a')} {one}", 3: f"{fill(900, 'é')} ({two}) and short item {fill(3, 'c')}",
        4: fill(20, "d"), 5: None, 6: f"{fill(900, 'e')} {' '.join(one.split(' ')[7:25])}",
    }
    docs = spark.createDataFrame([(i, t, len(t or ""), "s") for i, t in texts.items()], "doc_id long, text string, n_chars long, source string")
    bench = spark.createDataFrame([("1", one), ("2", two), ("3", "short item")], "item_id string, text string")
    got = {r["doc_id"]: r for r in D.drop_contaminated(docs, bench).collect()}
    want = {1: f"{fill(9000, 'a')}. ! {fill(9000, 'b')}", 3: f"{fill(900, 'é')} () and short item {fill(3, 'c')}", 4: texts[4], 5: None, 6: fill(900, "e") + " "}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"] or "") and r["source"] == "s" for r in got.values())


def test_columns_of_the_same_names_do_no_harm(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, "x")], "doc_id long, text string, n_words long, hits string")
    bench = spark.createDataFrame([("1", "b c")], "item_id string, text string")
    for block in (10**6, 1):
        (row,) = D.report(D.scan(docs, bench, block_words=block)).collect()
        assert (row["n_words"], row["n_hit"], row["items"]) == (3, 2, ["1"])
