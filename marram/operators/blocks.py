"""Rows of two tables met in blocks: each block one row of arrays, each pair of blocks one step of numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.storage import cut

#: Bytes of a block, and of an Arrow batch between the JVM and Python where the session sets none.
BLOCK_BYTES = 4 << 20


def bounded_batches(spark) -> None:
    """Bounds Arrow batches by bytes beside rows, unless the session has its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BLOCK_BYTES))


def packed(df: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most `rows` rows and about BLOCK_BYTES: every column as an array."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(parts):
            t = pa.Table.from_batches(parts).combine_chunks()
            whole = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), c.chunk(0)) for c in t.columns]
            return pa.RecordBatch.from_arrays(whole, names=t.column_names)

        parts, n, size = [], 0, 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                some = b.slice(at, min(rows - n, b.num_rows - at))
                at, n, size = at + some.num_rows, n + some.num_rows, size + some.nbytes
                parts.append(some)
                if n >= rows or size >= BLOCK_BYTES:
                    yield block(parts)
                    parts, n, size = [], 0, 0
        if parts:
            yield block(parts)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(pack, ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in df.schema))


def met(queries: DataFrame, rows: DataFrame, prepare: Callable, step: Callable, schema: str, *, most: int) -> DataFrame:
    """step(prepare(query columns), row columns) over every pair of blocks, as rows of schema. Columns come as Arrow arrays by name.
    Blocks are written first: their pairs read them again, and no side is broadcast or collected."""
    parts = max(1, -(-queries.count() // most))
    q = cut(packed(queries.repartition(parts), most), "blocks").select(F.struct("*").alias("q"))
    pairs = q.hint("shuffle_replicate_nl").crossJoin(cut(packed(rows, most), "blocks").select(F.struct("*").alias("r")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ready = None, None
        for b in batches:
            for i in range(b.num_rows):
                q, r = ({f.name: c.field(j).slice(i, 1).flatten() for j, f in enumerate(c.type)} for c in b.columns)
                if seen is None or not all(q[k].equals(seen[k]) for k in q):
                    seen, ready = q, prepare(**q)
                yield from step(ready, **r)

    return pairs.mapInArrow(run, schema)


# ---------------------------------------------------------------- sets


def _lists(x: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and the length of each list."""
    return x.flatten().to_numpy(zero_copy_only=False), np.diff(x.offsets.to_numpy())


def set_index(key: pa.Array, x: pa.Array) -> tuple:
    """Query sets: their items, the sets that hold each rare one, and a matrix of the frequent ones."""
    flat, m = _lists(x)
    of = np.repeat(np.arange(len(m)), m)
    items, at = np.unique(flat, return_inverse=True)
    held = np.bincount(at, minlength=len(items))
    often = held > max(8, len(m) // 16)
    rank = np.where(often, np.cumsum(often) - 1, -1)
    matrix = np.zeros((int(often.sum()), len(m)), np.float32)
    top = rank[at] >= 0
    matrix[rank[at[top]], of[top]] = 1
    return key, m, items, held, np.concatenate([[0], np.cumsum(held)]), of[np.argsort(at, kind="stable")], rank, matrix


def similar_sets(index: tuple, key: pa.Array, x: pa.Array, *, least: float, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """(a, b, common, m, n) of query sets a and sets b whose Jaccard similarity is `least` or more, a not b."""
    import pyarrow.compute as pc

    qkey, m, items, held, start, holders, rank, matrix = index
    flat, n = _lists(x)
    if not len(items) or not len(flat):
        return
    at = np.minimum(np.searchsorted(items, flat), len(items) - 1)
    known = items[at] == flat
    at, of = at[known], np.repeat(np.arange(len(n)), n)[known]
    bounds = np.searchsorted(of, np.arange(0, len(n) + rows, rows))
    alpha, wide = np.float32(least / (1 + least)), len(m)
    for k, lo in enumerate(range(0, len(n), rows)):
        some = n[lo : lo + rows]
        v, d = at[bounds[k] : bounds[k + 1]], of[bounds[k] : bounds[k + 1]] - lo
        top = rank[v] >= 0
        mine = np.zeros((len(some), len(matrix)), np.float32)
        mine[d[top], rank[v[top]]] = 1
        common = mine @ matrix
        v, d = v[~top], d[~top]
        times = held[v]
        if total := int(times.sum()):
            ends = np.cumsum(times)
            pick = np.arange(total) + np.repeat(start[v] - (ends - times), times)
            common += np.bincount(np.repeat(d * wide, times) + holders[pick], minlength=common.size).reshape(common.shape)
        # a margin for the rounding of 32 bits; the test itself is in 64
        i, j = np.nonzero(common >= alpha * (some[:, None].astype(np.float32) + m[None, :].astype(np.float32)) * np.float32(1 - 1e-5))
        c, a, b = common[i, j].astype(np.int64), m[j], some[i]
        good = (c > 0) & (c / (a + b - c) >= least) & (a >= least * b) & (b >= least * a)
        c, i, j = c[good], i[good] + lo, j[good]
        for s in range(0, len(c), 100_000):
            p, q = qkey.take(pa.array(j[s : s + 100_000])), key.take(pa.array(i[s : s + 100_000]))
            out = pa.RecordBatch.from_arrays([p, q, *(pa.array(z[s : s + 100_000].astype(np.int64)) for z in (c, m[j], n[i]))], names=["a", "b", "common", "m", "n"])
            yield out.filter(pc.fill_null(pc.not_equal(p, q), False))


# ---------------------------------------------------------------- vectors


def _vectors(v: pa.Array, norm: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal width, missing parts 0, and norms, 0 where there is none."""
    flat, n = _lists(v)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = np.nan_to_num(flat.astype(np.float64), nan=0.0)
    return out, np.nan_to_num(norm.to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0)


def vector_index(key: pa.Array, v: pa.Array, norm: pa.Array) -> tuple:
    return (key, *_vectors(v, norm))


def near_vectors(index: tuple, key: pa.Array, v: pa.Array, norm: pa.Array, *, k: int, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """(query, key, cos): of this block each query's `k` nearest by cosine to six decimals, then key. A matrix product finds those that
    may be among them; their cosines are summed place by place, as the column function does."""
    qkey, qv, qn = index
    rv, rn = _vectors(v, norm)
    width = min(qv.shape[1], rv.shape[1])
    qv, rv = qv[:, :width], rv[:, :width]
    place = np.empty(len(key), np.int64)
    place[pa.compute.sort_indices(key).to_numpy()] = np.arange(len(key))
    codes = pa.chunked_array([qkey, key]).dictionary_encode().combine_chunks()
    codes = (codes if isinstance(codes, pa.DictionaryArray) else codes.chunk(0)).indices.to_numpy(zero_copy_only=False)
    qc, rc = codes[: len(qkey)], codes[len(qkey) :]
    for lo in range(0, len(qkey), rows):
        scale = qn[lo : lo + rows, None] * rn[None, :]
        near = np.divide(qv[lo : lo + rows] @ rv.T, scale, out=np.zeros_like(scale), where=scale > 0)
        near[qc[lo : lo + rows, None] == rc[None, :]] = -np.inf
        last = -np.partition(-near, min(k, len(key)) - 1, axis=1)[:, min(k, len(key)) - 1]
        i, j = np.nonzero((near >= last[:, None] - 3e-6) & (near > -np.inf))
        cos = np.empty(len(i))
        for s in range(0, len(i), 100_000):
            a, b = qv[lo + i[s : s + 100_000]], rv[j[s : s + 100_000]]
            total = np.zeros(len(a))
            for d in range(width):
                total += a[:, d] * b[:, d]
            w = scale[i[s : s + 100_000], j[s : s + 100_000]]
            cos[s : s + 100_000] = np.divide(total, w, out=np.zeros_like(w), where=w > 0)
        order = np.lexsort((place[j], -np.sign(cos) * np.floor(np.abs(cos) * 1e6 + 0.5), i))
        i, j, cos = i[order], j[order], cos[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j, cos = i[first] + lo, j[first], cos[first]
        yield pa.RecordBatch.from_arrays([qkey.take(pa.array(i)), key.take(pa.array(j)), pa.array(cos)], names=["query", "key", "cos"])


def jaccard(queries: DataFrame, sets: DataFrame, least: float, *, most: int) -> DataFrame:
    """(a, b, common, m, n) over (key, x): arrays of distinct longs, none empty."""
    t = sets.schema["key"].dataType.simpleString()
    return met(queries, sets, set_index, partial(similar_sets, least=least), f"a {t}, b {t}, common long, m long, n long", most=most)


def nearest(queries: DataFrame, rows: DataFrame, k: int, *, most: int = 2000) -> DataFrame:
    """(query, key, cos) over (key, v, norm): at least each query's `k` nearest other rows."""
    t = rows.schema["key"].dataType.simpleString()
    return met(queries, rows, vector_index, partial(near_vectors, k=k), f"query {t}, key {t}, cos double", most=most)
