"""MinHash near-duplicate classes (operator 5).

Whole texts become sets of hashed word shingles, and equal sets one node; universal hash minima in bands put likely partners
together; connected components over band hubs give candidate families; in each family, in blocks of bounded size, signatures
tell which pairs may be linked, and those are confirmed on the full sets; components over the links, by large-star and
small-star, are the classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import M1, M2, M3, Workspace, as_long, bounded_batches, checked_broadcast, mix, runs
from .components import connected_components

#: 24 bands of 4 minima: a pair at similarity 0.85 is missed with probability (1 - 0.85**4)**24 = 2e-8, at 0.8 with 4e-6.
BANDS, ROWS = 24, 4
#: Bounds of a block of a family: documents, and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_000_000

#: A pair is confirmed where its signatures agree in as many minima as this many standard deviations below what is expected of a link.
DEVIATIONS = 6.0

_SIGNED = "doc_id long, hash long, n long, fp binary, bands array<long>, signature binary"


def shingle_sets(words, size: int) -> Iterator[np.ndarray]:
    """For each document of `words`, the sorted distinct 64-bit hashes of its shingles."""
    h, lo = words.hashes, words.lo
    n = len(h)
    if n >= size:
        s = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            s = s * M2 + h[k : n - size + 1 + k] * M3
        s = mix(s)
    for a, b in zip(lo[:-1], lo[1:], strict=True):
        if b - a >= size:
            yield np.unique(s[a : b - size + 1])
        elif b > a:  # fewer words: the sequence as one shingle, apart from those of `size` words
            x = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                x = x * M1 + h[k : k + 1]
            yield mix(x)
        else:
            yield np.zeros(0, np.uint64)


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class Minima:
    def __init__(self, bands: int, rows: int, seed: int = 20):
        r = np.random.Generator(np.random.PCG64(seed))
        self.bands, self.rows = bands, rows
        self.a = r.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def of(self, s: np.ndarray) -> np.ndarray:
        """The smallest a*x+b modulo 2**64 of each of the universal hashes."""
        least = None
        for k in range(0, len(s), 2048):
            m = (s[k : k + 2048, None] * self.a + self.b).min(0)
            least = m if least is None else np.minimum(least, m)
        return least

    def keys(self, least: np.ndarray) -> np.ndarray:
        """One key for each band."""
        m = least.reshape(self.bands, self.rows)
        x = np.arange(self.bands, dtype=np.uint64)
        for k in range(self.rows):
            x = mix(x * M2 + m[:, k])
        return as_long(x)


def _signer(size: int, bands: int, rows: int):
    def sign(batches):
        minima = Minima(bands, rows)
        for batch in batches:
            for at, words in runs(batch.column(2)):
                n, fp, keys, signatures = [], [], [], []
                for s in shingle_sets(words, size):
                    least = minima.of(s) if len(s) else np.zeros(0, np.uint64)
                    n.append(len(s))
                    fp.append(fingerprint(s))
                    keys.append(minima.keys(least) if len(s) else np.zeros(0, np.int64))
                    signatures.append((least >> np.uint64(32)).astype("<u4").tobytes())
                off = np.cumsum([0, *map(len, keys)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(n)) for k in (0, 1)), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), lists, pa.array(signatures, pa.binary())], names=["doc_id", "hash", "n", "fp", "bands", "signature"])

    return sign


def _sets(size: int):
    """Over (node, text): the set of each text as bytes."""

    def emit(batches):
        for batch in batches:
            for at, words in runs(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(words, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array(sets, pa.binary())], names=["node", "members"])

    return emit


def agreements(signatures: np.ndarray) -> np.ndarray:
    """In how many minima each two of the signatures (rows) agree."""
    m, width = signatures.shape
    out = np.zeros((m, m), np.int16)
    for k in range(width):
        out += signatures[:, k, None] == signatures[None, :, k]
    return out


def links_within(sets: list[np.ndarray], percent: int, split: int | None = None, signatures: np.ndarray | None = None) -> np.ndarray:
    """A component number for each set, by the links 100 * intersection >= percent * union; with `split`, only links of one
    before it with one from it on count. Where signatures (a row of minima for each set) are given, only pairs are looked at
    that agree in enough of them. Exact then: shared shingles are counted by products of 0/1 matrices."""
    every = len(sets)
    likely = np.ones((every, every), bool)
    if signatures is not None:
        width, share = signatures.shape[1], percent / 100
        likely = agreements(signatures) >= width * share - DEVIATIONS * (width * share * (1 - share)) ** 0.5
    np.fill_diagonal(likely, False)
    if split is not None:
        likely[:split, :split] = likely[split:, split:] = False
    some = np.flatnonzero(likely.any(1))  # sets without a likely partner are not compared
    of = np.arange(every)
    m = len(some)
    if not m:
        return of
    likely, sets = likely[np.ix_(some, some)], [sets[k] for k in some]
    sizes = np.array([len(s) for s in sets], np.float64)
    everything = np.concatenate(sets)
    row = np.repeat(np.arange(m), sizes.astype(np.int64))
    order = np.argsort(everything, kind="stable")
    e = everything[order]
    new = np.ones(len(e), bool)
    new[1:] = e[1:] != e[:-1]
    group = np.cumsum(new) - 1
    shared = np.bincount(group)[group] > 1  # a shingle in one set only is in no intersection
    col, row = group[shared], row[order][shared]
    if len(col):
        col = np.cumsum(np.r_[False, col[1:] != col[:-1]])
    both = np.zeros((m, m), np.float32)
    wide = max(1, (4 << 20) // m)
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, wide):
        i, j = np.searchsorted(col, [a, a + wide])
        x = np.zeros((m, min(wide, int(col[-1]) + 1 - a)), np.float32)
        x[row[i:j], col[i:j] - a] = 1
        both += x @ x.T
    linked = likely & (100.0 * both >= percent * (sizes[:, None] + sizes[None, :] - both))
    part = np.full(m, -1)
    for k in range(m):
        if part[k] < 0:
            part[k] = k
            front = np.array([k])
            while len(front):
                front = np.flatnonzero(linked[front].any(0) & (part < 0))
                part[front] = k
    of[some] = some[part]
    return of


def _linker(percent: int):
    """Over rows (family, i, j, block, node, signature, members) sorted by family, i, j: spanning links (a, b) of each block pair."""

    def flush(block, nodes, signatures, sets):
        order = sorted(range(len(nodes)), key=lambda k: (block[k], nodes[k]))
        a = np.array([nodes[k] for k in order], np.int64)
        split = sum(block[k] == min(block) for k in order)
        of = links_within([np.frombuffer(sets[k], np.uint64) for k in order], percent, split if split < len(a) else None, np.stack([np.frombuffer(signatures[k], "<u4") for k in order]))
        at = np.flatnonzero(of != np.arange(len(of)))
        return a[at], a[of[at]]

    def link(batches):
        key, rows = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            out = []
            for r, row in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3, 7)), strict=True)):
                if keys[r] != key:
                    if len(rows) > 1:
                        out.append(flush(*zip(*rows, strict=True)))
                    key, rows = keys[r], []
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b"])
        if len(rows) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in flush(*zip(*rows, strict=True))], names=["a", "b"])

    return link


def _classes(spark: SparkSession, docs: DataFrame, ws: Workspace, size: int, percent: int, bands: int, rows: int, block_docs: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """(signed: a row for each of docs with doc_id, hash of the text, n, fp; classes: fp, component_id, chosen). Classes hold the
    sets of two rows and more; chosen is one of the sets of a class that a document of the least id has."""
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    signed = ws.stage(texts.mapInArrow(_signer(size, bands, rows), _SIGNED), "signed")
    first = F.min(F.struct("doc_id", "hash"))
    nodes = signed.where("n > 0 and doc_id is not null").groupBy("fp").agg(first.alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.count(F.lit(1)).alias("copies"))
    nodes = ws.stage(nodes.select(F.monotonically_increasing_id().alias("node"), "fp", "first.doc_id", "first.hash", "n", "bands", "signature", "copies"), "nodes")
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    hubs = keyed.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    near = keyed.join(hubs, ["band", "key"]).where("node > hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    families = connected_components(spark, ws.stage(near, "near"), ws)
    members = families.select("node", F.col("root").alias("family"))
    members = members.unionByName(families.select(F.col("root").alias("node"), F.col("root").alias("family")).distinct())
    members = ws.stage(members.join(nodes.select("node", "doc_id", "hash", "n", "signature"), "node"), "members")
    blocks = members.groupBy("family").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(block_docs), F.sum("n") / F.lit(block_shingles))).cast("int").alias("blocks"))
    many = ws.stage(blocks.where("blocks > 1"), "large")
    split = many.count()
    # the set of each member, once
    wanted = checked_broadcast(members.select("node", F.col("doc_id").alias("d"), F.col("hash").alias("h")), 24)
    found = texts.join(wanted, (F.col("doc_id") == F.col("d")) & (F.col("hash") == F.col("h"))).select("node", "text")
    sets = ws.stage(found.mapInArrow(_sets(size), "node long, members binary"), "sets").dropDuplicates(["node"])  # repeated rows of it
    placed = members.join(checked_broadcast(many, 16, split), "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "signature")
    placed = placed.join(sets, "node").select("family", "i", "j", "block", "node", "signature", "members")
    placed = placed.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    links = ws.stage(placed.mapInArrow(_linker(percent), "a long, b long"), "links")
    # a family of one block is settled by it (b is its component's smallest); others need the components over all their blocks
    roots = connected_components(spark, links, ws) if split else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    of = nodes.select("node", "fp", "doc_id", "copies").join(roots, "node", "left").withColumn("own", F.coalesce("root", "node"))
    heads = roots.select("root").distinct()
    of = ws.stage(of.join(heads.withColumnRenamed("root", "head"), F.col("own") == F.col("head"), "left").where("copies > 1 or head is not null").select("own", "fp", "doc_id"), "linked")
    least = of.groupBy("own").agg(F.min(F.struct("doc_id", "fp")).alias("least"))
    classes = of.join(ws.stage(least, "least"), "own").select("fp", F.col("least.doc_id").alias("component_id"), (F.col("fp") == F.col("least.fp")).alias("chosen"))
    return signed, ws.stage(classes, "classes")


def near_duplicates(spark: SparkSession, docs: DataFrame, *, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs (doc_id: long, text: string).

    Words are runs of other than blanks, A-Z lower-cased. Documents are linked when 100 * |intersection| >= percent * |union|
    of their sets of `size`-word shingles; a text of fewer words is one shingle; a null, empty or blank text has none and is
    linked with nothing. component_id is the smallest linked doc_id, kept whether it is the document's own. Equal sets are one
    node, so groups of copies of any size cost one comparison. A null doc_id has itself (null) as component and is kept. Rows
    that share a doc_id are linked each by its own text, and may be in different classes. Other columns of docs are not read.
    """
    ws = Workspace(spark, "near")
    signed, classes = _classes(spark, docs, ws, size, percent, bands, rows, block_docs, block_shingles)
    out = signed.select("doc_id", "n", "fp").join(checked_broadcast(classes, 64), "fp", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(spark: SparkSession, docs: DataFrame, *, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of docs, all columns, one of each class of `near_duplicates`: of those with the least id the one of least text
    hash, and of rows equal in doc_id and text one. Rows without a doc_id stay. Texts are dealt only where the rejected rows'
    ids and hashes are too many to send to all."""
    ws = Workspace(spark, "deduplicated")
    signed, classes = _classes(spark, docs, ws, size, percent, bands, rows, block_docs, block_shingles)
    known = signed.where("doc_id is not null").select("doc_id", "hash", "fp").join(checked_broadcast(classes, 64), "fp", "left")
    known = known.groupBy("doc_id", "hash").agg(F.first("component_id").alias("component_id"), F.first("chosen").alias("chosen"), F.first("fp").alias("fp"), F.count(F.lit(1)).alias("n"))
    known = ws.stage(known, "known")
    mine = known.where("chosen and doc_id = component_id").groupBy("fp").agg(F.min("hash").alias("best"))
    known = known.join(checked_broadcast(ws.stage(mine, "best"), 40), "fp", "left")
    keep = F.col("component_id").isNull() | (F.col("chosen") & (F.col("doc_id") == F.col("component_id")) & (F.col("hash") == F.col("best")))
    dropped = ws.stage(known.where(~keep).select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")), "dropped")
    again = ws.stage(known.where(keep & (F.col("n") > 1)).select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")), "again")
    same = lambda side: (docs["doc_id"].cast("long") == side["__id"]) & (F.xxhash64(docs["text"]) == side["__hash"])
    side = checked_broadcast(dropped, 24)
    left = docs.join(side, same(side), "left_anti")
    n = again.count()
    if not n:
        return left
    side = checked_broadcast(again, 24, n)
    rest = left.join(side, (left["doc_id"].cast("long") == side["__id"]) & (F.xxhash64(left["text"]) == side["__hash"]), "left_anti")
    repeated = left.join(side, (left["doc_id"].cast("long") == side["__id"]) & (F.xxhash64(left["text"]) == side["__hash"]), "left_semi")
    return rest.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
