"""Repeated passages by sparse suffix arrays (operator 4).

Suffixes are kept only where a minimiser of word k-grams lies: every passage of `least` words has one, at a place that its own
words select, so copies of a passage keep the same suffixes. Suffixes whose first k words no other suffix shares are set aside.
The rest are brought together in order of that prefix and compared with what else starts so, extended to the left and to the
right as far as their windows reach: first all windows of a suffix at once, which settles copies of more than that; then window
by window for those that agree only in part. (Neighbours by right extension alone would lose passages that lie mostly to the
left of their minimiser, so order and neighbourhood are by 64-bit hashes of the extended passages; equal keys are adjacent.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import M2, Words, Workspace, _tables, as_long, bounded_batches, checked_broadcast, mix, runs

#: Least words of a passage, and words of a k-gram.
LEAST, GRAM = 50, 8
#: Stands for a null doc_id on the way, and comes before all others.
NO_ID = -(1 << 63)


class Passages:
    """Hashes of any run of words within `words`, by polynomial prefix sums."""

    def __init__(self, words: Words):
        n = len(words.hashes)
        power, self.inverse = _tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words.hashes * power[:n], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of words a to b."""
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64) * M2)


def suffixes(words: Words, passages: Passages, least: int, gram: int):
    """(p, a, b): minimiser positions, and the first and last start of the windows of `least` words that p is the minimiser of."""
    n = len(words.hashes)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(n - gram + 1)
    g = passages.of(at, at + gram)
    wide = least - gram + 1
    s = np.arange(n - least + 1)
    p = np.empty(len(s), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, wide)
    for i in range(0, len(s), 1 << 16):
        p[i : i + (1 << 16)] = view[i : i + (1 << 16)].argmin(1)
    p += s
    doc = np.searchsorted(words.lo, s, "right") - 1
    s_ok = s + least <= words.lo[doc + 1]
    s, p = s[s_ok], p[s_ok]
    if not len(s):
        return (np.zeros(0, np.int64),) * 3
    new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)])
    last = np.r_[new[1:], len(s)] - 1
    return p[new], s[new], s[last]


_SUFFIX = "doc_id long, key long, all long, p int, a int, b int"


def _sampler(least: int, gram: int):
    def sample(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, words in runs(batch.column(1)):
                passages = Passages(words)
                p, a, b = suffixes(words, passages, least, gram)
                doc = np.searchsorted(words.lo, p, "right") - 1
                base = words.lo[doc]
                n = len(words.lo) - 1
                key, every = as_long(passages.of(p, p + gram)), as_long(passages.of(a, b + least))
                null = np.ones(n, bool)
                cols = [
                    pa.array(np.r_[ids[at + doc], ids[at : at + n]]),
                    pa.array(np.r_[key, np.zeros(n, np.int64)], mask=np.r_[np.zeros(len(p), bool), null]),  # a row without key: the document, its words in a
                    pa.array(np.r_[every, np.zeros(n, np.int64)]),
                    *(pa.array(np.r_[x, y].astype(np.int32)) for x, y in ((p - base, np.zeros(n)), (a - base, np.diff(words.lo)), (b - base, np.zeros(n)))),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "all", "p", "a", "b"])

    return sample


def _windows(least: int):
    """(doc_id, text, ranges of starts, open): a row (w, doc_id, s, open) for each window."""

    def emit(batches):
        for batch in batches:
            ids, ranges = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for at, words in runs(batch.column(1)):
                passages, cols = Passages(words), []
                for d in range(len(words.lo) - 1):
                    lo, n = int(words.lo[d]), int(words.lo[d + 1] - words.lo[d])
                    for r in ranges[at + d]:
                        s = np.arange(r["a"], min(r["b"], n - least) + 1)
                        if len(s):
                            cols.append((as_long(passages.of(lo + s, lo + s + least)), np.full(len(s), ids[at + d]), s.astype(np.int32), np.full(len(s), r["open"])))
                if cols:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*cols, strict=True)], names=["w", "doc_id", "s", "open"])

    return emit


def _merged(spans):
    """Sorted (s, e) structs as disjoint ones."""
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def add(acc, x):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (x["s"] <= F.get(acc, F.size(acc) - 1)["e"])
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(joins, grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(spans, empty, add)


def repeated_passages(spark: SparkSession, docs: DataFrame, *, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_repeated (words in passages of at least `least` words that occur twice or more, in one document or in
    several), spans and later (their word ranges [s, e); later: only where another occurrence comes before, by doc_id and place).

    Words are runs of other than blanks, A-Z lower-cased, over whole texts. Null and short texts have no passages; rows without
    a doc_id are one document whose id is null; rows that share an id are one document with the passages of each, of as many words
    as the longest. An empty table gives no rows. Removing `later` keeps the first.
    """
    ws = Workspace(spark, "suffix")
    bounded_batches(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    sampled = ws.stage(rows.mapInArrow(_sampler(least, gram), _SUFFIX), "suffixes")
    words = sampled.where("key is null").groupBy("doc_id").agg(F.max("a").cast("long").alias("n_words"))
    found = sampled.where("key is not null")
    # written first: then both sides of the join are plain exchanges, and a common key's rows are split among tasks
    shared = ws.stage(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
    live = ws.stage(found.join(shared, "key", "left_semi"), "shared")
    alike = live.groupBy("key", "all").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "p", "a", "b")).alias("first"))
    alike = ws.stage(alike, "alike")
    settled = live.join(ws.stage(alike.where("n > 1").select("key", "all", "first"), "settled"), ["key", "all"])
    later = (F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.p") != F.col("p"))
    spans = settled.select("doc_id", F.col("a").alias("s"), (F.col("b") + least).alias("e"), later.alias("later"))
    # what agrees only in part: one of each set of suffixes alike, against those of other sets with that key
    mixed = ws.stage(alike.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "mixed")
    parts = alike.join(mixed, "key", "left_semi").select("first.*", (F.col("n") == 1).alias("open"))
    wanted = ws.stage(parts.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b", "open")).alias("ranges")), "ranges")  # at most one for each word of the text
    texts = rows.join(wanted, "doc_id").select("doc_id", "text", "ranges")
    windows = ws.stage(texts.mapInArrow(_windows(least), "w long, doc_id long, s int, open boolean"), "windows")
    twice = windows.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "s")).alias("first")).where("n > 1")
    twice = ws.stage(twice.select("w", "first"), "repeated")
    part = windows.join(checked_broadcast(twice, 40), "w")
    later = (F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.s") != F.col("s"))
    spans = spans.unionByName(part.select("doc_id", "s", (F.col("s") + least).alias("e"), "open", later.alias("later")).where("open or later").drop("open"))
    by = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("x"), F.sort_array(F.collect_set(F.when(F.col("later"), F.struct("s", "e")))).alias("y"))
    by = by.select("doc_id", _merged(F.col("x")).alias("spans"), _merged(F.col("y")).alias("later"))
    none = F.array().cast("array<struct<s:int,e:int>>")
    out = words.join(by, "doc_id", "left").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("later", none).alias("later"))
    return out.withColumn("n_repeated", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"]))
