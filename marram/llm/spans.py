"""What the span finders share: spans as (start, end, kind) in code points, their strings, and the Arrow side."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa

Span = tuple[int, int, str]


def joined(spans: list[Span], kinds: list[str]) -> str:
    """kind:start:end by start, then by kind as listed, then end, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], rank[s[2]], s[1])))


def span_rows(find: Callable[[str], tuple[list[Span], list[Span]]], base: list[str], kinds: list[str]):
    """A mapInArrow function over (doc_id, text): doc_id, n_<kind> for each base kind, base_sha256, spans.

    find gives a text's base spans and the added ones. Texts are taken one at a time; null is empty.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts: list[list[int]] = [[] for _ in base]
                hashes, spans = [], []
                for x in part.column(1):
                    found, added = find(x.as_py() or "")
                    for c, k in zip(counts, base, strict=True):
                        c.append(sum(s[2] == k for s in found))
                    hashes.append(hashlib.sha256(joined(found, base).encode()).hexdigest())
                    spans.append(joined(found + added, kinds))
                cols = [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"])

    return run


def span_schema(id_type: str, base: list[str]) -> str:
    return f"doc_id {id_type}, " + "".join(f"n_{k} long, " for k in base) + "base_sha256 string, spans string"
