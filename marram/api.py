"""The public surface: each call takes DataFrames and returns DataFrames (or a dict of them), lazily where it can.

A corpus is a table (path, text) with optional age_days; code relations come from `build_code_index`.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions import text as T
from marram.operators import code as C
from marram.operators import documents as D
from marram.operators import edits as E
from marram.operators import graph as G
from marram.operators import integrity as I
from marram.operators import retrieval as R
from marram.operators import search as S
from marram.sources import files as src
from marram.storage import cut


def build_code_index(files: DataFrame) -> dict[str, DataFrame]:
    """Symbols, imports, edges (src, dst), unresolved and call edges of source files (path, text), each written once."""
    code = files.where(T.extension(F.col("path")).isin(src.SYMBOL_EXTENSIONS))
    symbols, imports, calls = (cut(f(code), n) for n, f in (("symbols", C.symbols), ("imports", C.imports), ("calls", C.calls)))
    wanted = imports.select("path", "specifier").distinct()
    resolved = cut(G.resolve_imports(wanted, code), "resolved")
    edges = resolved.where("resolved is not null").select(F.col("path").alias("src"), F.col("resolved").alias("dst"))
    unresolved = resolved.where("resolved is null and specifier rlike '^[./]'").select("path", "specifier")
    bindings = imports.where("local is not null and not type_only").join(resolved, ["path", "specifier"]).select("path", "local", F.col("resolved").alias("source"), F.col("imported").alias("name"))
    defined = symbols.select("path", "name", F.concat_ws(":", "path", "name").alias("id"))
    sites = calls.where("caller is not null").select(F.concat_ws(":", "path", "caller").alias("caller"), "path", "callee")
    called = cut(G.resolve_calls(sites, defined, bindings.where("source is not null")), "calls")
    return {"symbols": symbols, "imports": imports, "edges": edges, "unresolved": unresolved, "calls": called.select(F.col("caller").alias("src"), F.col("dst"), "tier")}


def search(corpus: DataFrame, query: str, kind: str | None = None, most: int = 20) -> DataFrame:
    """By file name, directory or content; by the look of the query where kind is not given."""
    kind = kind or ("directory" if query.endswith("/") else "filename" if "/" in query or "." in query.rsplit(" ", 1)[-1] else "content")
    if kind == "filename":
        return S.top_k(corpus.select("path", S.filename_fuzzy(F.col("path"), query).alias("score")).where("score > 0"), most, tie="path")
    if kind == "directory":
        d = corpus.where(F.contains(F.lower("path"), F.lit(query.lower()))).select(F.regexp_replace("path", "/[^/]*$", "/").alias("path")).distinct()
        return d.orderBy("path").limit(most)
    return R.scout(corpus if "age_days" in corpus.columns else corpus.withColumn("age_days", F.lit(0)), query, R.ScoutOptions(most_results=most))


def explore(corpus: DataFrame, query: str | None = None, paths: list[str] | None = None, *, scope: str = "all", page: int = 0, per_page: int = 8) -> dict[str, DataFrame]:
    """Documents and code that answer a query, a page at a time; or the texts of paths, sensitive and binary ones left out."""
    if query is None:
        wanted = corpus.where(T.path_filter(F.col("path"), paths or [], [])).where(~T.is_sensitive(F.col("path")) & ~T.is_binary(F.col("path")))
        return {"files": wanted.select("path", T.truncated(F.col("text"), 2000).alias("preview"))}
    docs = corpus.where(src.is_document(F.col("path")) & T.in_scope(F.col("path"), scope, logs=True, metrics=True))
    code = corpus.where(T.extension(F.col("path")).isin(src.SYMBOL_EXTENSIONS))
    page_of = lambda d: d.where(F.col("rank").between(page * per_page + 1, (page + 1) * per_page))
    most = (page + 1) * per_page
    return {"docs": page_of(R.doc_search(docs, query, R.SearchOptions(results=most))), "code": page_of(search(code, query, "content", most))}


def doc_outline(docs: DataFrame) -> DataFrame:
    """(doc, line, end_line, level, title, path_of, ordinal, section_id): sections of documents (path, text), by markdown headings,
    or by inferred ones where there are none."""
    return _sections(docs)


def doc_links(docs: DataFrame) -> DataFrame:
    links = D.markdown_links(D.lines(docs, "path"), "path").withColumn("resolved", D.resolve_link(F.col("path"), F.col("href")))
    return links.withColumn("category", T.link_category(F.col("resolved")))


def doc_section(docs: DataFrame, heading: str) -> DataFrame:
    """The sections whose heading path comes closest to `heading` (titles joined by ' > ')."""
    want = F.array(*(F.lit(h.strip().lower()) for h in heading.split(">")))
    score = S.heading_path_score(F.transform(F.split(F.lower("path_of"), " > "), F.trim), want)
    best = _sections(docs).withColumn("score", score).where("score >= 2")
    return best.select("doc", "line", "end_line", "title", "score").orderBy(F.desc("score"), "doc", "line")


def _sections(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("path").alias("doc"), "text")
    n = D.lines(d, "doc")
    md = D.markdown_headings(n, "doc")
    plain = D.text_headings(n, "doc").join(md.select("doc").distinct(), "doc", "left_anti")
    return D.outline(md.unionByName(plain), n.groupBy("doc").agg(F.count(F.lit(1)).alias("n_lines")), "doc").withColumnRenamed("path", "path_of")


def relationships(spark: SparkSession, index: dict[str, DataFrame], node: str, mode: str = "dependencies", *, direction: str = "downstream", depth: int = 3) -> dict[str, DataFrame]:
    """(nodes, edges) around a file or symbol, by dependencies or calls."""
    edges = index["calls" if mode == "calls" else "edges"].select("src", "dst").distinct()
    near = G.bfs(spark, edges, spark.createDataFrame([(node,)], ["node"]), depth=depth, direction=direction)
    inside = near.select("node").unionByName(spark.createDataFrame([(node,)], ["node"]))
    within = edges.join(inside.select(F.col("node").alias("src")), "src", "left_semi").join(inside.select(F.col("node").alias("dst")), "dst", "left_semi")
    return {"nodes": near, "edges": within}


def understand(spark: SparkSession, files: DataFrame, index: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Profile, symbols, dependencies both ways and rank of one file."""
    one = files.where(F.col("path") == path)
    ranks = G.pagerank(spark, index["edges"], rounds=12).where(F.col("node") == path)
    deg = G.degrees(index["edges"])
    return {
        "profile": D.format_profile(one, "path"),
        "symbols": index["symbols"].where(F.col("path") == path),
        "downstream": relationships(spark, index, path)["nodes"],
        "upstream": relationships(spark, index, path, direction="upstream")["nodes"],
        "role": ranks.join(deg, "node", "left").select("node", "rank", G.role(F.col("rank"), F.coalesce("n_in", F.lit(0)), F.coalesce("n_out", F.lit(0))).alias("role")),
    }


def plan_change(spark: SparkSession, index: dict[str, DataFrame], path: str, first: int, last: int) -> DataFrame:
    """One row: what an edit of lines first to last of a file touches, and its risk. Nothing is written."""
    touched = index["symbols"].where((F.col("path") == path) & (F.col("start_line") <= last) & (F.col("end_line") >= first)).count()
    files = G.bfs(spark, index["edges"], spark.createDataFrame([(path,)], ["node"])).count()
    score = G.risk_score(F.lit(files), F.lit(touched), F.lit(0.0), F.lit(0), F.lit(any(x in path for x in ("index.ts", "main.ts", "App.tsx"))))
    return spark.range(1).select(F.lit(path).alias("path"), F.lit(files).alias("files"), F.lit(touched).alias("symbols"), score.alias("score"), G.risk_level(score).alias("risk"))


def references(index: dict[str, DataFrame], files: DataFrame, name: str) -> DataFrame:
    """(path, line, text) of lines that name a symbol, in files that define or import it."""
    homes = index["symbols"].where(F.col("name") == name).select("path").unionByName(index["imports"].where((F.col("imported") == name) | (F.col("local") == name)).select("path")).distinct()
    return S.line_matches(files.join(homes, "path", "left_semi"), T.ascii_words(rf"\b{name}\b"), "path", most=None)


def hot_spots(index: dict[str, DataFrame], most: int = 30) -> DataFrame:
    n_in = index["edges"].groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("n"))
    s = index["symbols"].join(n_in, "path", "left")
    entry = F.col("path").rlike(r"(^|/)index\.(ts|js)x?$") & F.col("exported")
    d = s.select("path", "name", G.hot_spot_score(F.coalesce("n", F.lit(0)), F.col("name"), entry, F.col("type")).alias("score")).where("score > 0")
    return d.orderBy(F.desc("score"), "path", "name").limit(most)


def integrity(docs: DataFrame, scope: str = "docs") -> dict[str, DataFrame]:
    """Claims, conflicts and the report of documents (path, text)."""
    claims = I.text_claims(D.lines(docs.where(T.in_scope(F.col("path"), scope)), "path"))
    found = I.conflicts(I.constraints(claims))
    return {"claims": claims, "findings": found, "report": I.report(found), "domains": I.top_domains(found)}


def suggest_similar(index: dict[str, DataFrame], name: str, most: int = 5) -> DataFrame:
    d = index["symbols"].select("name").distinct().select("name", S.symbol_fuzzy(F.col("name"), name).alias("score")).where("score is not null")
    return d.orderBy(F.desc("score"), "name").limit(most)


#: Names under which the calls are reached, as from a plan of steps.
TOOLS: dict[str, Callable[..., Any]] = {
    "search": search, "explore": explore, "understand": understand, "change": plan_change, "relationships": relationships, "references": references, "hotspots": hot_spots,
    "integrity": integrity, "doc_toc": doc_outline, "doc_links": doc_links, "doc_section": doc_section, "doc_search": R.doc_search, "status": G.index_status, "read_fragment": E.fragments,
    "suggest": suggest_similar, "list_files": src.list_files,
}


def run_steps(steps: list[tuple[str, str, dict[str, Any]]]) -> dict[str, Any]:
    """Runs (result name, tool, arguments) in order; an argument '${name}' or '${name.key}' is an earlier result or a part of it."""
    done: dict[str, Any] = {}

    def value(x: Any) -> Any:
        if isinstance(x, str) and x.startswith("${") and x.endswith("}"):
            head, *rest = x[2:-1].split(".")
            out = done[head]
            for k in rest:
                out = out[k]
            return out
        return x

    for name, tool, arguments in steps:
        done[name] = TOOLS[tool](**{k: value(v) for k, v in arguments.items()})
    return done
