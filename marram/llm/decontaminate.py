"""Benchmark decontamination (operator 8): a broadcast set of hashed item windows, found in whole texts and confirmed word for word."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_NON_ALNUM, M2, M3, Words, bounded_batches, mix, runs

#: Most bytes of benchmark text that are sent to the executors at once; more is scanned in parts of this size.
PART_BYTES = 16 << 20


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = np.zeros(n, np.uint64)
    for k in range(size):
        s = s * M2 + h[k : n + k] * M3
    return mix(s + np.uint64(size))


class Windows:
    """The windows of benchmark items: for each length, sorted hashes, a bitmap before them, and the texts for confirmation."""

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        self.of: dict[bytes, set[str | None]] = defaultdict(set)
        hashes: dict[int, set[int]] = defaultdict(set)
        for item, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            w = Words(raw, np.array([0, len(raw)]), ASCII_NON_ALNUM)
            length = min(size, len(w.hashes))
            if length:
                for k, h in enumerate(window_hashes(w.hashes, length).tolist()):
                    hashes[length].add(h)
                    self.of[w.text(k, k + length)].add(item)
        self.sets = {}
        for length, x in sorted(hashes.items()):
            a = np.array(sorted(x), np.uint64)
            bits = np.zeros(1 << 20, bool)
            bits[a >> np.uint64(44)] = True
            self.sets[length] = a, bits

    def hits(self, words: Words):
        """(first word, length, items) of every occurrence within one document."""
        for length, (known, bits) in self.sets.items():
            h = window_hashes(words.hashes, length)
            at = np.flatnonzero(bits[h >> np.uint64(44)])
            if not len(at):
                continue
            k = np.searchsorted(known, h[at])
            at = at[known[np.minimum(k, len(known) - 1)] == h[at]]
            doc = np.searchsorted(words.lo, at, "right") - 1
            for i in at[at + length <= words.lo[doc + 1]].tolist():
                if items := self.of.get(words.text(i, i + length)):
                    yield i, length, items


def _scanner(windows):
    def scan(batches):
        known = windows.value
        for batch in batches:
            ids = batch.column(0)
            for at, words in runs(batch.column(1), ASCII_NON_ALNUM):
                n = len(words.lo) - 1
                spans: list[list[list[int]]] = [[] for _ in range(n)]
                items: list[set] = [set() for _ in range(n)]
                for i, length, found in known.hits(words):
                    d = int(np.searchsorted(words.lo, i, "right")) - 1
                    a = i - int(words.lo[d])
                    spans[d].append([a, a + length])
                    items[d] |= found
                out = []
                for s in spans:
                    merged: list[list[int]] = []
                    for a, b in sorted(s):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    out.append(merged)
                count = [int(x) for x in np.diff(words.lo)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array(count, pa.int64()), pa.array(out, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x, key=lambda s: (s is None, s or "")) for x in items], pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])

    return scan


def _filter(windows, spans: bool):
    """Over whole rows, text last: those without a hit, or all with the hit words cut out of the text."""

    def scan(batches):
        known = windows.value
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            hit: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for at, words in runs(text, ASCII_NON_ALNUM):
                for i, length, _ in known.hits(words):
                    d = int(np.searchsorted(words.lo, i, "right")) - 1
                    lo = int(words.offsets[d])
                    hit[at + d].append((int(words.starts[i]) - lo, int(words.ends[i + length - 1]) - lo))
            if hit and not spans:
                batch = batch.filter(pa.array([k not in hit for k in range(batch.num_rows)]))
            elif hit:
                out = text.to_pylist()
                for k, cuts in hit.items():
                    raw, end, parts = out[k].encode(), 0, []
                    for a, b in sorted(cuts):
                        if b > end:
                            parts.append(raw[end : max(a, end)])
                            end = b
                    out[k] = b"".join([*parts, raw[end:]]).decode()
                batch = batch.set_column(batch.num_columns - 1, batch.schema.field(batch.num_columns - 1), pa.array(out, text.type))
            if batch.num_rows:
                yield batch

    return scan


def _broadcast_windows(spark: SparkSession, benchmark: DataFrame, size: int, part_bytes: int) -> list:
    """The benchmark's windows as broadcasts: one if its bytes fit part_bytes, else one for each part of the items."""
    bounded_batches(spark)
    known = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-2 * total // part_bytes)) if total > part_bytes else 1
    out = []
    for k in range(parts):
        mine = known if parts == 1 else known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        out.append(spark.sparkContext.broadcast(Windows([(r[0], r[1]) for r in mine.toLocalIterator()], size)))
    return out


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, size: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, spans (merged word ranges [start, end) that occur in the benchmark), items (their item ids as strings, a
    null last for items without an id) for each row of docs (doc_id, text).

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; a window is `size` consecutive
    words of an item, or all words of a shorter one. A null or empty text has no words, an item without words no window, an
    empty benchmark hits nothing. The benchmark's bytes are summed first; beyond `part_bytes` it is scanned for in parts, each
    no larger. Rows equal in doc_id and text are joined then and repeated as often as one part's scan gave them.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, spans array<array<long>>, items array<string>"
    rows, known = docs.select("doc_id", "text"), _broadcast_windows(spark, benchmark, size, part_bytes)
    if len(known) == 1:
        return rows.mapInArrow(_scanner(known[0]), schema)
    keyed = rows.select(F.struct("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")).alias("doc_id"), "text")
    schema = schema.replace(f"doc_id {dict(docs.dtypes)['doc_id']}", f"doc_id {dict(keyed.dtypes)['doc_id']}")
    found = [keyed.mapInArrow(_scanner(w), schema) for w in known]
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    every = every.groupBy("doc_id").agg((F.count(F.lit(1)) / len(known)).cast("long").alias("copies"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    joined = lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))[1] >= s[0]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(F.get(acc, F.size(acc) - 1)[0], F.greatest(F.get(acc, F.size(acc) - 1)[1], s[1]))))).otherwise(F.concat(acc, F.array(s)))
    every = every.select("doc_id.doc_id", "n_words", F.aggregate("spans", F.array().cast("array<array<long>>"), joined).alias("spans"), "items", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return every.drop("col")


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, size: int = 10, spans: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of docs, all columns, without those that hold a benchmark window; with `spans`, all rows without the hit words.
    Rows pass through as Arrow batches, so nothing is shuffled or joined."""
    rest = [c for c in docs.columns if c != "text"]
    out = docs.select(*rest, "text")
    for w in _broadcast_windows(spark, benchmark, size, part_bytes):
        out = out.mapInArrow(_filter(w, spans), out.schema)
    return out.select(*docs.columns)


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
