"""9. Substring dedup by sliding sentence spans.

Every run of two or more consecutive sentences with `least` words or more counts (white space and A-Z case do not).  Equal
runs are joined over the whole corpus; of each repeated run the first occurrence stays, in the order of (doc_id, text
hash, place), and the sentences of every other occurrence are removed.

Not every run has to be hashed for that.  A run is hashed if it is the shortest from its first sentence on, or the
shortest up to its last one: at most two a sentence.  Within a repeated run of any length these shorter ones overlap or
meet from end to end, and repeat with it at the same places, so the sentences removed are those of all runs.

Runs are counted and their first places found by an aggregate that is combined before the shuffle; a run that a third of
all documents share is one row there.  Its other occurrences are joined back to that row, and a hot run is split by
adaptive execution, since its row is unique and in a table of its own.  Nothing is capped.

Defined cases: a null text is an empty one without sentences; a text of fewer than `least` words has no run; of equal
rows (same id and text) none is first before the others, so all keep the run's first occurrence; an equal text under
another id loses what its first copy holds; null ids sort before others; a very long text is split into its sentences whole,
so that memory grows with its length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, chunks, mix64, prefix_hash, table, text_of, with_columns_of, written

LEAST = 20
END = "(?<=[.!?…。])(?=\\s)|(?<=\\n)"


#: The same on UTF-8 bytes.
END_BYTES = re.compile(rb"(?:(?<=[.!?])|(?<=\xe2\x80\xa6)|(?<=\xe3\x80\x82))(?=[ \t\n\x0b\f\r])|(?<=\n)")


def sentences(text: Column) -> Column:
    """Pieces of a text, together the whole text; a piece ends after . ! ? before white space, or after a line."""
    return F.filter(F.split(text, END), lambda s: s != "")


def spans(row: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs to hash; row and words are each sentence's row and number of words."""
    n = len(row)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total, at = np.concatenate([[0], np.cumsum(words)]), np.arange(n)
    end = np.searchsorted(row, row, side="right")
    last = np.maximum(at + 1, np.searchsorted(total, total[:-1] + least) - 1)  # of the shortest run from a sentence on
    # runs that are the shortest up to their last sentence go on to where the next sentence's begin, or the row ends
    beyond = np.minimum(np.concatenate([last[1:], [n]]), end)
    count = np.where(last < end, np.maximum(1, beyond - last), 0)
    first = np.repeat(at, count)
    step = np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
    return first, np.repeat(last, count) + step


def runs_of(docs: DataFrame, least: int) -> DataFrame:
    """(id, tid, h, i, j) of docs (id, tid, t): hash, first and last sentence of each run.  White space alone is no sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_of(batch, "t")
            for x, y in chunks(off):
                row, number, words, hashes = [], [], [], []
                for k in range(x, y):
                    i = -1
                    for piece in END_BYTES.split(raw[off[k] : off[k + 1]].tobytes().lower()):
                        i += piece != b""
                        if parts := piece.split():
                            row.append(k)
                            number.append(i)
                            words.append(len(parts))
                            hashes.append(hashlib.blake2b(b" ".join(parts), digest_size=8).digest())
                first, last = spans(np.array(row, np.int64), np.array(words, np.int64), least)
                if not len(first):
                    continue
                value = np.frombuffer(b"".join(hashes), np.uint64)
                sums, inverse = prefix_hash(np.arange(len(value)), value)
                h = mix64((sums[last + 1] - sums[first]) * inverse[first]).view(np.int64)
                of, place = pa.array(np.array(row)[first]), np.array(number, np.int32)
                cols = [batch.column("id").take(of), batch.column("tid").take(of), pa.array(h), pa.array(place[first]), pa.array(place[last])]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "tid", "h", "i", "j"])

    return arrow_map(docs.select("id", "tid", "t"), run, "id long, tid long, h long, i int, j int")


def repeated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, tid, cut): numbers of the sentences to remove, of the texts that have any."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # equal rows give the same places twice, which are one place below
    runs = written(runs_of(docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("tid"), text.alias("t")), least))
    first = runs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "tid", "i")).alias("f")).where("n > 1").select("h", "f")
    first = written(first)  # a plain side, so that the join can split a hot run
    here = F.struct("id", "tid", "i")
    later = runs.join(first, "h").where(~here.eqNullSafe(F.col("f")))
    later = later.select("id", "tid", F.explode(F.sequence("i", "j")).alias("s"))
    return later.groupBy("id", "tid").agg(F.collect_set("s").alias("cut"))


def remove(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_sentences, n_removed, cut (sorted numbers, from 0, of removed sentences) and kept (text) of each row."""
    cut = written(repeated(docs, least))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = cut.select(F.col("id").alias("id0"), F.col("tid").alias("tid0"), "cut")
    t = docs.select("doc_id", text.alias("t"), F.xxhash64(text).alias("tid"))
    t = t.join(cut, F.col("doc_id").eqNullSafe(F.col("id0")) & (F.col("tid") == F.col("tid0")), "left")
    gone = F.coalesce(F.array_sort("cut"), F.array().cast("array<int>"))
    t = t.select("doc_id", sentences(F.col("t")).alias("s"), gone.alias("cut"), "t")
    # removed sentences are marked by their place; most texts have none
    marks = F.transform(F.col("s"), lambda s, i: F.when(~F.array_contains(F.col("cut"), i), s))
    kept = F.when(F.size("cut") == 0, F.col("t")).otherwise(F.array_join(F.filter(marks, lambda s: s.isNotNull()), ""))
    return t.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.size("cut").cast("long").alias("n_removed"), "cut", kept.alias("kept"))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove(with_columns_of(table(spark, sf_dir, "documents"), ("doc_id", "long"), ("text", "string")))
    return out.select("doc_id", "n_sentences", "n_removed", F.array_join("cut", ",").alias("cut"), F.octet_length("kept").cast("long").alias("kept_bytes"), F.sha2("kept", 256).alias("kept_sha256"))
