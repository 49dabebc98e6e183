"""6. Benchmark decontamination with a generalised suffix automaton.

The test items' words (lower-cased runs of letters, digits and non-ASCII characters) build a suffix automaton over word
ids.  Documents stream through it: at each word the automaton knows the longest run ending there that lies in an item.
A run of `window` words marks those words as hit; an item of fewer words is marked where it occurs whole.  Only
stretches of words that all occur in the items, and are long enough, are walked; they are found on whole batches.

A document of which hit words are 5 % or more is dropped.  From the others, hit runs of `window` words or more are cut;
shorter ones are whole short items, which also occur by chance, and stay.  The query reports; `drop_contaminated` cuts.

The automaton is broadcast.  Its size is checked: items are packed into blocks of at most `block_words` words, and
documents pass one block after the other, with a table written in between, so that no executor holds more than a block.
A block is a pass over the documents, as a stated query set in blocks.

Defined cases: a null document or item text has no words; an item without words is no window; an item that is longer
than a block is one block; a null item_id is written as an empty string; repeated items and documents count each for
themselves, but an item_id counts once; a very long text is walked in one go, with memory in proportion to its words; windows of
several items in one place give the place once and all their ids; empty tables give no hits or an empty result; further columns
stay, but those named as the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, chunks, schema_of, table, text_of, with_columns_of, words_of, written

WINDOW = 13
#: Words of an automaton: about 900 bytes each in a Python worker, so some 180 MB.
BLOCK_WORDS = 200_000


class Automaton:
    """A suffix automaton of several word sequences, with the windows that end in each state."""

    def __init__(self, items: Iterable[tuple[str, np.ndarray]], window: int = WINDOW):
        self.window = window
        items = [(i, w) for i, w in items if len(w)]
        self.vocab = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, np.searchsorted(self.vocab, w).tolist()) for i, w in items]
        for _, word_ids in coded:
            last = 0
            for c in word_ids:
                last = self._extend(last, c)
        # items by the state and length of their windows; shorter windows of suffix states are linked from longer ones
        self.ends: dict[int, dict[int, set[str]]] = {}
        for i, word_ids in coded:
            n = min(window, len(word_ids))
            for at, state, run in self.walk(word_ids):
                if run >= n and (len(word_ids) > n or at == len(word_ids) - 1):
                    while self.length[self.link[state]] >= n:
                        state = self.link[state]
                    self.ends.setdefault(state, {}).setdefault(n, set()).add(i)
        self.shortest = min((n for e in self.ends.values() for n in e), default=0)
        # the nearest state with windows on the way of suffix links, itself included
        self.near = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.near[s] = s if s in self.ends else self.near[self.link[s]]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def walk(self, word_ids: Iterable[int]) -> Iterator[tuple[int, int, int]]:
        """Place, state and longest matching run after each word."""
        nxt, link, length = self.next, self.link, self.length
        state = run = 0
        for at, c in enumerate(word_ids):
            while state and c not in nxt[state]:
                state = link[state]
                run = length[state]
            if c in nxt[state]:
                state, run = nxt[state][c], run + 1
            yield at, state, run

    def windows(self, word_ids: Iterable[int]) -> Iterator[tuple[int, int, set[str]]]:
        """End (exclusive), length and items of each window that ends at a place."""
        for at, state, run in self.walk(word_ids):
            s = self.near[state]
            while s:
                for n, items in self.ends[s].items():
                    if n <= run:
                        yield at + 1, n, items
                s = self.near[self.link[s]]

    def stretches(self, h: np.ndarray, breaks: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """First place and word ids of the maximal runs of item words, within rows, that can hold a window."""
        if not len(h) or not self.shortest:
            return
        ids = np.searchsorted(self.vocab, h)
        ids[ids == len(self.vocab)] = 0
        known = self.vocab[ids] == h
        first, last = known.copy(), known.copy()
        first[1:] &= ~known[:-1]
        last[:-1] &= ~known[1:]
        cut = breaks[(breaks > 0) & (breaks < len(h))]
        first[cut], last[cut - 1] = known[cut], known[cut - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        long = e - s >= self.shortest
        for a, b in zip(s[long].tolist(), e[long].tolist()):
            yield a, ids[a:b].tolist()


def marks(automaton: Automaton, raw: np.ndarray, off: np.ndarray, hit: list[list], items: list[set[str]]) -> np.ndarray:
    """Adds hit words (first, end) and items of each row to hit and items; returns each row's number of words."""
    total = np.zeros(len(off) - 1, np.int64)
    for i, j in chunks(off):
        h, s, _ = words_of(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        first = np.searchsorted(s, off[i : j + 1] - off[i])
        total[i:j] = np.diff(first)
        for a, word_ids in automaton.stretches(h, first):
            row = int(np.searchsorted(first, a, side="right")) - 1
            for end, n, which in automaton.windows(word_ids):
                at = a + end - int(first[row])
                spans = hit[i + row]
                if spans and spans[-1][1] >= at - n and spans[-1][0] <= at - n:
                    spans[-1][1] = max(spans[-1][1], at)
                else:
                    spans.append([at - n, at])
                items[i + row] |= which
    return total


def merged(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


STATE = "n_words long, hits array<array<int>>, items array<string>"


def pass_block(docs: DataFrame, automaton: Automaton, again: bool = False) -> DataFrame:
    """docs with n_words, hits and items, added to what an earlier pass (again) has put there; else columns of these names go."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(automaton)  # at most a block, see item_blocks
    keep = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    schema = schema_of(docs, keep, STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_of(b, "text")
            n = len(off) - 1
            hit = [list(map(list, x)) for x in b.column("hits").to_pylist()] if again else [[] for _ in range(n)]
            items = [set(x) for x in b.column("items").to_pylist()] if again else [set() for _ in range(n)]
            words = marks(shared.value, raw, off, hit, items)
            cols = [b.column(c) for c in keep] + [
                pa.array(words, pa.int64()),
                pa.array([merged(x) for x in hit], pa.list_(pa.list_(pa.int32()))),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "n_words", "hits", "items"])

    return arrow_map(docs, run, schema)


def item_blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Automaton]:
    """Automata of the items, of at most block_words words each; the driver holds one block at a time."""
    items = with_columns_of(benchmark, ("item_id", "string"), ("text", "string")).where("text is not null")
    block, size = [], 0
    for row in items.toLocalIterator():
        raw = np.frombuffer(row["text"].encode(), np.uint8)
        h, _, _ = words_of(raw, np.array([0, len(raw)]))
        if block and size + len(h) > block_words:
            yield Automaton(block, window)
            block, size = [], 0
        block.append((row["item_id"] or "", h))
        size += len(h)
    yield Automaton(block, window)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, hits (maximal runs of hit words as [first, end)) and items (ids that occur)."""
    for i, automaton in enumerate(item_blocks(benchmark, window, block_words)):
        docs = pass_block(written(docs) if i else docs, automaton, i > 0)
    return docs


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(scanned: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + (x[1] - x[0]).cast("long"))
    out = scanned.withColumn("n_hit", n_hit)
    return out.withColumns({
        "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.array_join(F.array_sort("items"), ","), 256),
        "contaminated": contaminated(F.col("n_hit"), F.col("n_words")),
    })


def cut_spans(scanned: DataFrame, keep: tuple[str, ...], window: int = WINDOW) -> DataFrame:
    """The kept columns of scanned and rest: the text without its hit runs of `window` words or more; null if it has none."""
    long = F.filter("hits", lambda x: x[1] - x[0] >= window)
    rows = scanned.select(*keep, long.alias("hits"), F.when(F.size(long) > 0, F.col("text")).alias("text"))
    schema = schema_of(rows, keep, "rest string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_of(b, "text")
            rest: list[str | None] = []
            for k, hits in enumerate(b.column("hits").to_pylist()):
                t = raw[off[k] : off[k + 1]]
                if not hits:
                    rest.append(None)
                    continue
                _, s, e = words_of(t, np.array([0, len(t)]))
                keeps = np.ones(len(t), bool)
                for x, y in hits:
                    keeps[s[x] : e[y - 1]] = False
                rest.append(t[keeps].tobytes().decode())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(rest, pa.string())], names=schema.names)

    return arrow_map(rows, run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, without the passages of items that they hold.

    Rows that hold none are unchanged; of others, text is cut, and n_chars counted anew where docs has it.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text").cast("string").alias("text"))
    out = cut_spans(report(scan(packed, benchmark)).where(~F.col("contaminated")), ("__row",))
    new = {"text": F.col("rest"), "n_chars": F.char_length("rest")}
    value = lambda c: F.when(F.col("rest").isNull(), F.col("__row")[c]).otherwise(new[c].cast(docs.schema[c].dataType)) if c in new else F.col("__row")[c]
    return out.select(*[value(c).alias(c) for c in docs.columns])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_columns_of(table(spark, sf_dir, "documents"), ("doc_id", "long"), ("text", "string"))
    out = report(scan(docs, table(spark, sf_dir, "benchmark")))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
