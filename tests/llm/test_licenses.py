import difflib
import random
import types

import zstandard

from tracewell.llm import licenses as L


def test_every_template_is_found_and_told_apart():
    s, r = L.Scanner(), random.Random(3)
    prose = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n))
    for name, texts in L.TEMPLATES.items():
        for t in texts:
            doc = prose(80) + "\n" + t + "\n" + prose(60)
            assert {x[2] for x in s.scan(doc)} == {name}, (name, t, s.scan(doc))


def test_mentions_are_not_notices():
    s = L.Scanner()
    for t in ("He lost his driving license in 1990.", "All licenses differ, and the public domain is large.", "", "license " * 1000):
        assert s.scan(t) == [], t


def test_spans_hold_the_notice():
    t = "one\n\nReleased under the MIT License.\n\ntwo"
    ((a, b, name, saving, differing),) = L.Scanner().scan(t)
    assert (t[a:b], name, differing) == ("Released under the MIT License.", "MIT", 0) and saving > 0.3


def test_rows(hard, empty):
    assert L.scan(hard).count() == hard.count()
    assert L.scan(empty).collect() == []


def test_notices_inside_long_lines():
    s, r = L.Scanner(), random.Random(5)
    prose = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n))
    for n in (10, 50, 100, 500, 3000):
        for name, texts in L.TEMPLATES.items():
            for t in texts:
                assert {x[2] for x in s.scan(f"{prose(n)} {t} {prose(n)}")} == {name}, (n, name, t)


def test_several_notices_of_one_block():
    s = L.Scanner()
    mit = L.TEMPLATES["MIT"][1].replace("sublicense", "lend").replace("merge", "join")
    assert {x[2] for x in s.scan("Licensed under CC BY 4.0.\n" + mit)} == {"CC-BY-4.0", "MIT"}
    four = ("CC-BY-4.0", "MIT", "CC-BY-SA-4.0", "GPL-3.0", "Apache-2.0")
    for gap in (" ", "\n"):
        assert {x[2] for x in s.scan(gap.join(L.TEMPLATES[k][0] for k in four))} == set(four)


def edited(words, missing, r):
    """Words with `missing` of them replaced, dropped or moved away, never the cue words."""
    w = list(words)
    free = [i for i, x in enumerate(w) if not L.CUE.search(x)]
    for i in r.sample(free[1:-1], min(missing, len(free) - 2)):
        w[i] = r.choice(("zzz", "", "qqq vvv"))
    return " ".join(x for x in w if x)


def test_all_templates_with_all_allowed_edits_against_the_word_rule():
    """Every template with 0 to one more than the allowed number of words replaced, alone and inside prose: found exactly if a tenth
    of its words at most are gone, as a count over the words (longest common subsequence) says."""
    s, r = L.Scanner(), random.Random(9)
    prose = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    right = total = 0
    for name, texts in L.TEMPLATES.items():
        for t in texts:
            want = L.words(t)
            for missing in range(len(want) // 10 + 2):
                for shape in ("{}", "{p} {} {p}", "{p}\n{}\n{p}"):
                    doc = shape.replace("{p}", prose(40)).replace("{}", edited(t.split(" "), missing, r))
                    lost = len(want) - common(want, L.words(doc))
                    found = name in {x[2] for x in s.scan(doc)}
                    total += 1
                    right += found == (lost <= len(want) // 10)
                    assert not found or lost <= len(want) // 10, (name, lost, doc)
    print(right, "of", total)
    assert right >= 0.95 * total


def test_wording_names_the_differences():
    mit = L.TEMPLATES["MIT"][1].replace("sublicense", "lend").replace("merge, ", "")
    ((_, _, name, _, differing, how),) = L.Scanner().spans(mit)
    assert (name, differing, how) == ("MIT", 2, "-merge -sublicense +lend")


def test_hard_licenses(spark):
    """Nulls, empty and very long texts with notices, repeated rows and clashing columns."""
    notice = "Released under the MIT License."
    long = "words and words " * 60_000 + notice + " words" * 60_000
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, notice, "x", 1), (3, notice, "x", 1), (None, notice, None, None), (4, long, "x", 1), (5, notice + "\n" + notice, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_blocks long")
    got = sorted(((r["doc_id"] or 0, r["n_blocks"], tuple(r["licenses"])) for r in L.scan(docs).collect()))
    assert got == [(0, 1, ("MIT",)), (1, 0, ()), (2, 0, ()), (3, 1, ("MIT",)), (3, 1, ("MIT",)), (4, 1, ("MIT",)), (5, 1, ("MIT",))]


def found_words(low):
    return [(m[0], m.start(), m.end()) for m in L.WORD.finditer(low)]


def test_every_window_is_compressed_with_every_template_before_words_are_compared(monkeypatch):
    """What is compressed with which dictionary, and where the first comparison of words falls."""
    steps = []

    def compressor(*a, real=zstandard.ZstdCompressor, dict_data=None, **kw):
        inner = real(*a, **kw) if dict_data is None else real(*a, dict_data=dict_data, **kw)
        given = b"" if dict_data is None else dict_data.as_bytes().rstrip(b"\n")
        return types.SimpleNamespace(compress=lambda x: steps.append((given, x)) or inner.compress(x))

    monkeypatch.setattr(L, "zstandard", types.SimpleNamespace(**{k: getattr(zstandard, k) for k in dir(zstandard)} | {"ZstdCompressor": compressor}))
    monkeypatch.setattr(L, "difflib", types.SimpleNamespace(SequenceMatcher=lambda *a, **kw: steps.append(("words",)) or difflib.SequenceMatcher(*a, **kw)))
    templates = {t.lower().encode() for ts in L.TEMPLATES.values() for t in ts}
    for text in ("He lost his driving license in 1990.", "one\nReleased under the MIT License. two"):
        steps.clear()
        L.Scanner().scan(text)
        first = next((i for i, x in enumerate(steps) if x == ("words",)), len(steps))
        assert {g for g, x in steps[:first] if b"license" in x} == templates | {b""}, text


def test_ranking_against_all_windows():
    """The ranking against a plain loop over windows; whatever the words allow is in it, with any words between and any around."""
    s, r = L.Scanner(), random.Random(11)
    prose = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n))
    saves = lambda k, x: len(L.squeeze().compress(x)) - len(L.squeeze(s.rows[k][1].lower().encode()).compress(x))
    for k, (name, t, want) in enumerate(s.rows):
        for between in (0, 1, len(want)):
            for n in (0, 5, 20, 200):
                w = t.lower().split()
                for i in sorted(r.sample(range(len(w)), min(between, len(w) - 1)), reverse=True):
                    w.insert(i + 1, prose(1))
                low = f"{prose(n)} {' '.join(w)} {prose(n)}".strip()
                if not L.CUE.search(low):
                    continue  # the word between split the cue
                found = found_words(low)
                got = s.ranked(low, found)
                assert any(x[2] == k for x in got), (name, between, n, low)
                assert got == sorted(got) and all(-x == saves(j, low[found[a][1] : found[b - 1][2]].encode()) > 0 for _, x, j, a, b in got[:3])
                if not between:
                    assert s.rows[got[0][2]][0] == name, (n, t, s.rows[got[0][2]])


def test_rank_decides_where_the_wording_does_not():
    """Two templates miss one word each and share the rest; the one of which the text holds the larger share is taken."""
    rest = "of the shared terms of this public software license as they are printed in full below"
    templates = {"A": (f"Zebra {rest}",), "B": (f"Noncommercially {rest}",)}
    ((_, _, name, _, differing, _),) = L.Scanner(templates).spans(f"noncommercial {rest}")
    assert (name, differing) == ("B", 1)
