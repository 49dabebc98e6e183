import hashlib
from collections import Counter

import pytest

from tracewell.llm import substrings as S


def brute(texts: list[bytes], length: int):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cut = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                cut[i : i + length] = b"\1" * length
        kept = bytes(c for c, x in zip(t, cut) if not x)
        out.append((len(t), sum(cut), sum(x and not p for p, x in zip(b"\0" + cut, cut)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_bytes_removed_match_brute_force(spark, hard, hot):
    rows = hard.collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, brute([(r["text"] or "").encode() for r in rows], 60)))
    got = Counter(tuple(r) for r in S.remove(hard, length=60, gram=20, hot=hot).collect())
    assert got == want


def test_default_length(spark, hard):
    rows = hard.collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, brute([(r["text"] or "").encode() for r in rows], 200)))
    assert Counter(tuple(r) for r in S.remove(hard).collect()) == want


def test_very_long_texts_are_searched_in_pieces(monkeypatch):
    import random

    import numpy as np

    r = random.Random(5)
    monkeypatch.setattr(S, "PIECE", 64)
    monkeypatch.setattr(S, "chunks", lambda off: ((i, i + 1) for i in range(len(off) - 1)))
    base = "".join(r.choice("abcdefgh") for _ in range(300))
    texts = [(base[a : a + 160] + "".join(r.choice("ab") for _ in range(90))).encode() for a in (0, 40, 41, 120)]
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    groups = {}
    for row, place, first, last, h, _ in S.text_anchors(raw, off, 30, 8):
        for a, b, c, d, e in zip(row.tolist(), place.tolist(), first.tolist(), last.tolist(), h.tolist()):
            groups.setdefault(e, []).append((a, b, b - c, d + 30 - b))
    cut = [bytearray(len(t)) for t in texts]
    for g in groups.values():
        for (a, b, _, _), iv in zip(g, S.covers([(texts[a][b - m : b], texts[a][b : b + n]) for a, b, m, n in g], 30)):
            for x, y in iv:
                cut[a][b + x : b + y] = b"\1" * (y - x)
    assert [sum(c) for c in cut] == [x[1] for x in brute(texts, 30)]


def test_maximal_repeats_hold_all_occurrences():
    spans = [(b"xxAB", b"CDEF"), (b"yyAB", b"CDEF"), (b"zzAB", b"CDQQ"), (b"qqqq", b"CDEF")]
    got = {(m, n, tuple(sorted(g))) for m, n, g in S.maximal_repeats(spans, 4)}
    assert got == {(2, 2, (0, 1, 2)), (2, 4, (0, 1)), (0, 4, (0, 1, 3))}


def test_empty(empty):
    assert S.remove(empty).collect() == []
