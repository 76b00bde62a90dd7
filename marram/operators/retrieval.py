"""End-to-end retrieval: scout over files, and document search over chunks with fusion, diversity and evidence packs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marram.functions import text as T
from marram.operators import documents as D
from marram.operators import search as S
from marram.storage import cut


@dataclass(frozen=True)
class ScoutOptions:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    intent: str = "code"
    most_candidates: int = 800
    most_results: int = 20
    snippet: int = 240


def scout(files: DataFrame, query: str, options: ScoutOptions = ScoutOptions(), *, symbols: DataFrame | None = None, comments: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(path, score, matches, preview, rank) over files (path, text, age_days), with symbols (path, name), comments (path, text) and
    dependency edges (src, dst: paths) where they are at hand.

    Path filters reach the scan; one narrow pass counts query tokens and literal matches. Candidates are files with a query token,
    a literal match, a keyword in their name or a symbol that holds one; those with a name or symbol come before the cap, then the
    best by BM25. On the candidates all seven signals are weighed; then come the core gate (a literal match, a name or a symbol),
    deduplication by preview and the final rank. A query without keywords finds nothing.
    """
    keywords = T.query_tokens(query)
    kept = files.where(T.path_filter(F.col("path"), options.include, options.exclude))
    if options.types:
        kept = kept.where(T.extension(F.col("path")).isin([t if t.startswith(".") else f".{t}" for t in options.types]))
    pattern = "(?i)(" + "|".join(_escaped(k) for k in keywords) + ")" if keywords else "(?!)"
    hit_lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\r?\n"), lambda x: x.rlike(pattern))
    kept = kept.withColumn("lines", T.line_count(F.col("text"))).withColumn("hits", F.least(F.size(hit_lines), F.lit(10))).withColumn("preview", T.truncated(F.coalesce(F.get(hit_lines, F.lit(0)), F.lit("")), options.snippet))
    c = S.bm25(kept, query, "path", keep=["lines", "hits", "preview", "age_days"], every=True).withColumn("name", S.filename_signal(F.col("path"), keywords))
    c = _with(c, S.symbol_signal(symbols, keywords).where("symbol > 0") if symbols is not None and keywords else None, "symbol")
    core = (F.col("name") > 0) | (F.col("symbol") > 0)
    c = c.where((F.col("score") > 0) | (F.col("hits") > 0) | core).orderBy(core.desc(), F.desc("score"), "path").limit(options.most_candidates)
    c = cut(c, "candidates")  # most_candidates rows; the signals below read their paths
    near = F.broadcast(c.select("path").distinct())
    c = _with(c, S.comment_signal(comments.join(near, "path", "left_semi"), keywords) if comments is not None and keywords else None, "comment")
    stem = F.regexp_replace("path", r"\.(test|spec)(\.[^./]+)$", "$2")
    c = _with(c, files.where(F.col("path").rlike(r"\.(test|spec)\.[^./]+$")).select(stem.alias("path")).join(near, "path", "left_semi").distinct().withColumn("tested", F.lit(1.0)), "tested")
    c = _with(c, edges.select("src", F.col("dst").alias("path")).join(near, "path", "left_semi").groupBy("path").agg(F.countDistinct("src").alias("n_in")) if edges is not None else None, "n_in")
    signals = {
        "content": S.normalized_signal(F.col("score"), 100, F.col("lines")),
        "filename": S.normalized_signal(F.col("name"), 100),
        "symbol": S.normalized_signal(F.col("symbol"), 100),
        "comment": S.normalized_signal(F.col("comment"), 100),
        "test": F.col("tested"),
        "recency": S.recency_signal(F.col("age_days")),
        "outbound": S.outbound_signal(F.col("n_in")),
    }
    total = S.hybrid_total(options.intent, signals, F.col("score"), F.col("hits"))
    d = c.withColumn("total", total).where((F.col("total") > 0) & ((F.col("hits") > 0) | core))
    # equal previews count once; without a preview the path tells rows apart
    d = S.first_by(d.withColumn("__k", F.when(F.col("preview") != "", F.col("preview")).otherwise(F.col("path"))), ["__k"], [F.desc("total"), "path"])
    d = d.select("path", F.col("total").alias("score"), F.col("hits").cast("long").alias("matches"), "preview")
    return S.top_k(d, options.most_results, tie="path")


def _with(rows: DataFrame, signal: DataFrame | None, name: str) -> DataFrame:
    """rows with the signal of their path as a number, 0 where there is none."""
    if signal is None:
        return rows.withColumn(name, F.lit(0.0))
    return rows.join(signal.select("path", F.col(name).cast("double").alias(name)), "path", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def _escaped(word: str) -> str:
    import re

    return re.escape(word)


@dataclass(frozen=True)
class SearchOptions:
    results: int = 8
    most_files: int = 60
    most_chunks: int = 400
    most_vectors: int = 60
    dims: int = 64
    rrf_k: int = 60
    rrf_depth: int = 200
    lam: float = 0.7
    evidence_chars: int = 8000
    snippet: int = 240
    chunk_chars: int = 1200

    def pack_id(self, query: str) -> str:
        """Equal queries and options have equal packs."""
        return hashlib.sha256(json.dumps({"query": query, **asdict(self)}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def chunk_table(docs: DataFrame, target: int = 1200) -> DataFrame:
    """(path, chunk, start_line, end_line, text, content_hash): lines packed to the target; the fold and the slices stay in one row."""
    ls = F.split("text", "\r?\n")
    p = D.packed_chunks(docs, target, "path").select("path", "chunk", "start_line", "end_line")
    spans = p.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("chunk", "start_line", "end_line"))).alias("s"))
    d = docs.join(spans, "path").select("path", ls.alias("l"), F.explode("s").alias("s"))
    text = F.array_join(F.slice("l", F.col("s.start_line").cast("int"), (F.col("s.end_line") - F.col("s.start_line") + 1).cast("int")), "\n")
    return d.select("path", "s.chunk", "s.start_line", "s.end_line", text.alias("text")).withColumn("content_hash", F.sha2("text", 256))


def hash_embedding(tokens, dims: int):
    """A dense signed-hash vector of an array of tokens, L2-normalised. Hashes, vector and norm are each computed once."""
    once = lambda x, f: F.transform(F.array(x), f)[0]
    at = lambda h, i: F.aggregate(F.filter(h, lambda x: x % dims == i), F.lit(0.0), lambda a, x: a + F.when(x % 2 == 0, 1.0).otherwise(-1.0))
    dense = once(F.transform(tokens, T.fnv1a), lambda h: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: at(h, i)))
    return once(dense, lambda v: once(T.l2_norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def doc_search(docs: DataFrame, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(path, chunk, start_line, end_line, score, bm25, cosine, preview, rank) of documents (path, text).

    Files by BM25, their chunks by BM25, vectors of the best only, fusion of both rankings, diversity, then evidence within the
    character budget. Each stage hands on a bounded top-k, so only the first two read the corpus.
    """
    o = options
    files = S.bm25(docs, query, "path").orderBy(F.desc("score"), "path").limit(o.most_files).select("path")
    chunks = chunk_table(docs.join(F.broadcast(files), "path", "left_semi"), o.chunk_chars)  # at most most_files paths
    keyed = chunks.withColumn("id", F.concat_ws("#", "path", "chunk"))
    scored = S.bm25(keyed, query, "id", keep=["path", "chunk", "start_line", "end_line", "text"])
    best = scored.orderBy(F.desc("score"), "id").limit(o.most_chunks)
    terms = F.array(*map(F.lit, S._query_tokens(query)))
    top = best.orderBy(F.desc("score"), "id").limit(o.most_vectors).withColumn("v", hash_embedding(T.tokens(F.col("text")), o.dims))
    top = top.withColumn("cosine", T.dot(F.col("v"), hash_embedding(terms, o.dims)))
    top = cut(top.select("id", "path", "chunk", "start_line", "end_line", "text", "score", "v", "cosine"), "top")  # most_vectors rows, read four times below
    by_text = S.ranked(top.select("id", "score"), tie="id").select("id", "rank")
    by_vector = S.ranked(top.select("id", F.round("cosine", 9).alias("score")), tie="id").select("id", "rank")
    fused = S.reciprocal_rank_fusion(by_text, by_vector, "id", k=o.rrf_k, depth=o.rrf_depth)
    d = top.join(fused, "id").withColumn("q", F.lit(1))
    order = S.maximal_marginal_relevance(d.select("q", "id", "rrf", "v"), "q", "id", "rrf", "v", k=max(3 * o.results, 12), lam=o.lam)
    d = d.join(order.select("id", "place"), "id")
    d = d.withColumn("preview", F.substring("text", 1, o.snippet))
    d = S.within_budget(d, F.length("preview"), ["place"], o.evidence_chars, rows=o.results)
    return d.select("path", "chunk", "start_line", "end_line", F.col("rrf").alias("score"), F.col("score").alias("bm25"), "cosine", "preview", F.row_number().over(Window.orderBy("place")).cast("long").alias("rank"))
