"""What the operators of this package share: staged tables, size-checked broadcasts, vectorised word hashing."""

from __future__ import annotations

import contextlib
import itertools
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its rows, counted, stay below this many bytes.
BROADCAST_BYTES = 8 << 20
#: Bytes of an Arrow batch between the JVM and Python where the session sets none: long texts make batches of few rows.
BATCH_BYTES = 4 << 20

_numbers = itertools.count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes beside rows, unless the session has its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session on one machine (tests) gets
    a folder of its own; on a cluster that is an error, as executors would write where nobody else can read."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "marram-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Workspace:
    """A folder below the shared one for the written tables that cut lineage; `drop` removes those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/marram/{name}-{uuid.uuid4().hex[:12]}"
        for opened in _opened:
            opened.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{next(_numbers):04d}-{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet and reads it back: computed once, and a lost executor costs only the tasks it ran."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._marram_path = path
        return out

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            if df is not None and (path := getattr(df, "_marram_path", None)):
                self._delete(path)


_opened: list[list[Workspace]] = []


@contextlib.contextmanager
def workspaces_dropped():
    """Within it, results must be written or collected: at its end, the folders of all workspaces made in it are removed."""
    mine: list[Workspace] = []
    _opened.append(mine)
    try:
        yield
    finally:
        _opened.remove(mine)
        for ws in mine:
            ws._delete(ws.root)


def checked_broadcast(df: DataFrame, row_bytes: int, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the limit; otherwise as it is, for a shuffled join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= limit else df


# ---------------------------------------------------------------- words of Arrow batches, as numpy arrays

_rng = np.random.Generator(np.random.PCG64(0x6D617272616D))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
M1, M2, M3 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x9FB21C651E98DF25)
_SPAN = 1 << 20

#: Bytes that separate words.
BLANKS = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
ASCII_NON_ALNUM = np.array([c < 0x80 and not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) for c in range(256)])
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_LOWERED = _BYTE[_FOLD]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * M1
    return h ^ (h >> np.uint64(32))


_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _SPAN + 4096)
        out = []
        for b in (_BASE, _INVERSE):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        if size > 4 * _SPAN:  # one very long word; not kept
            return out
        _powers[:] = out
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of data[start:end], with `fold` A-Z as a-z; polynomial prefix sums over spans of about 1 MB."""
    table = _LOWERED if fold else _BYTE
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        b = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, b + _SPAN)))
        e = int(ends[j - 1])
        power, inverse = _tables(e - b + 1)
        sums = np.empty(e - b + 1, np.uint64)
        sums[0] = 0
        np.cumsum(table[data[b:e]] * power[: e - b], out=sums[1:])
        s, t = starts[i:j] - b, ends[i:j] - b
        out[i:j] = mix((sums[t] - sums[s]) * inverse[s])
        i = j
    return out


class Words:
    """The words of a run of documents: byte spans in `data`, hashes, and `lo` (the words of document d are lo[d]:lo[d+1])."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, hashed: bool = True):
        sep = separators[data] if len(data) else np.zeros(0, bool)
        word = ~sep
        first, last = word.copy(), word.copy()
        if len(data):
            first[1:] &= sep[:-1]
            last[:-1] &= sep[1:]
            at = offsets[:-1][offsets[:-1] < offsets[1:]]
            first[at] = word[at]
            last[at[at > 0] - 1] = word[at[at > 0] - 1]
        self.data, self.offsets = data, offsets
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.lo = np.searchsorted(self.starts, offsets)
        if hashed:
            self.hashes = word_hashes(data, self.starts, self.ends)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, lower-cased, with single spaces between."""
        return b" ".join(self.data[s:e].tobytes().lower() for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets into them; null is empty."""
    c = pc.fill_null(column, "") if column.null_count else column
    c = c.cast(pa.large_string()) if not pa.types.is_large_string(c.type) else c
    _, off, data = c.buffers()
    offsets = np.frombuffer(off, np.int64)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(column: pa.Array, separators: np.ndarray = BLANKS, most: int = 2 << 20):
    """Yields (first row, Words) for runs of rows of about `most` bytes together; a longer text is a run of its own."""
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], separators)
        i = j


def as_long(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)
