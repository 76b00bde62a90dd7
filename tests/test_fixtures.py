"""Small inputs with values that follow from the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from marram.functions import text as T
from marram.operators import documents as D
from marram.operators import graph as G
from marram.operators import integrity as I
from marram.operators import search as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "install the tool"), (1, "use the tool"), (2, "cache cleared, install again install")], ["doc_id", "text"])
    got = lambda q: {r["doc_id"]: round(r["score"], 6) for r in S.bm25(docs, q).collect()}
    assert got("install") == {0: 0.507772, 2: 0.586293}
    assert got("install tool") == {0: 1.015544, 1: 0.507772, 2: 0.586293}
    assert got("install install") == {0: 1.015544, 2: 1.172586}


@pytest.mark.parametrize("token,value", [("install", 2221138336), ("tool", 1366625991), ("the", 3020861980)])
def test_fnv(spark, token, value):
    assert one(spark, T.fnv1a(F.col("t")), t=token) == value


def test_trigrams(spark):
    assert one(spark, T.trigrams(F.col("t")), t="Foo-Bar!") == ["foo", "oo ", "o b", " ba", "bar"]
    assert one(spark, T.trigrams(F.col("t")), t="ab") == []


def test_rrf(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1)], ["id", "rank"])
    b = spark.createDataFrame([("x", 2), ("y", 1)], ["id", "rank"])
    got = {r["id"]: round(r["rrf"], 6) for r in S.reciprocal_rank_fusion(a, b, "id").collect()}
    assert got == {"x": 0.032522, "y": 0.032787}


@pytest.mark.parametrize("text,intent", [("class User", "symbol"), ("interface Config", "symbol"), ("function start", "symbol"), ("tsconfig.json", "file"), ("README.md", "file"), ("fix error", "bug"), ("check validation", "bug"), ("auth logic", "code"), ("user management", "code")])
def test_intent(spark, text, intent):
    assert one(spark, T.query_intent(F.col("t")), t=text) == intent


@pytest.mark.parametrize("raw,lines,want", [(0, 10, 0), (50, 10, 0.5), (100, 10, 1), (200, 10, 1), (100, 2000, 0.9)])
def test_normaliser(spark, raw, lines, want):
    assert one(spark, S.normalized_signal(F.col("r"), 100, F.col("l")), r=raw, l=lines) == want


def test_call_graph_boost(spark):
    c = lambda **v: one(spark, S.call_graph_boost(*(F.col(k) for k in v)), **v)
    assert abs(c(depth=0, entry=True, n_in=10, n_out=5, rank=0.0) - (1 + 6 + math.log2(17) * 1.5)) < 1e-9
    assert abs(c(depth=3, entry=False, n_in=0, n_out=1, rank=0.0) - (1 + 1 + math.log2(3) * 1.5)) < 1e-9


def test_mmr(spark):
    # b is all but a's copy, c is far from both
    d = spark.createDataFrame([(1, "a", 0.9, [1.0, 0.0]), (1, "b", 0.85, [0.95, 0.3122]), (1, "c", 0.3, [0.1, 0.995])], ["q", "id", "rel", "v"])
    got = S.maximal_marginal_relevance(d, "q", "id", "rel", "v", k=3).orderBy("place").collect()
    assert [r["id"] for r in got] == ["a", "b", "c"]


def test_text_headings(spark):
    text = "intro\nPROJECT OVERVIEW\n\nGetting Started\n===\n1. Install\nrun\nUsage\n-----\nx"
    got = D.text_headings(D.lines(spark.createDataFrame([(1, text)], ["doc_id", "text"]))).orderBy("line").collect()
    assert [(r["title"], r["level"], r["line"]) for r in got] == [("PROJECT OVERVIEW", 2, 2), ("Getting Started", 1, 4), ("Install", 2, 6), ("Usage", 2, 8)]


def test_html(spark):
    html = "<h2>Install</h2>\n<script>x</script><p>Hello <b>world</b> &amp; others</p>\n<a href='/docs/'>d</a>\n<img src=/img/logo.png>"
    p = spark.createDataFrame([(1, html)], ["page_id", "html"])
    text = p.select(T.html_text(F.col("html")).alias("t")).first()["t"]
    assert text.split("\n")[1] == "Hello world & others" and "x" not in text
    assert [(r["level"], r["title"]) for r in D.html_headings(p).collect()] == [(2, "Install")]
    assert [r["href"] for r in D.html_references(p).collect()] == ["/docs/", "/img/logo.png"]


def test_reference_link(spark):
    text = "[Install][install]\n\n[install]: docs/guide.md\n```\n[no](x.md)\n```\n![i](a.png)"
    got = D.markdown_links(D.lines(spark.createDataFrame([(1, text)], ["doc_id", "text"]))).collect()
    assert [(r["label"], r["href"], r["line"]) for r in got] == [("Install", "docs/guide.md", 1)]


def test_mentions(spark):
    text = "Use `FooService` in src/app.ts or ./foo/bar\n<MyWidget/> and {useState}\nthe FooClient reads config.yaml\n```\nHiddenSymbol\n```"
    got = {r["text"] for r in D.mentions(D.lines(spark.createDataFrame([(1, text)], ["doc_id", "text"]))).collect()}
    assert {"FooService", "src/app.ts", "./foo/bar", "MyWidget", "useState", "FooClient", "config.yaml"} <= got and "HiddenSymbol" not in got


def test_pagerank(spark):
    ring = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A")], ["src", "dst"])
    assert all(abs(r["rank"] - 1 / 3) < 1e-9 for r in G.pagerank(spark, ring, rounds=5).collect())
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "C"), ("C", "D")], ["src", "dst"])
    got = {r["node"]: round(r["rank"], 6) for r in G.pagerank(spark, e, rounds=12).collect()}
    assert got == {"A": 0.120435, "B": 0.171609, "C": 0.317513, "D": 0.390443}


def test_dependencies(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("X", "Y"), ("Y", "X")], ["src", "dst"])
    start = lambda n: spark.createDataFrame([(n,)], ["node"])
    assert {r["node"] for r in G.bfs(spark, e, start("A")).collect()} == {"B", "C"}
    assert {r["node"] for r in G.bfs(spark, e, start("C"), direction="upstream").collect()} == {"A", "B"}
    assert {r["node"] for r in G.cyclic_nodes(spark, e).collect()} == {"X", "Y"}


def test_module_resolution(spark):
    imports = spark.createDataFrame([("src/main.ts", "./utils"), ("src/main.ts", "./shared"), ("src/main.ts", "./does-not-exist"), ("src/main.ts", "react")], ["path", "specifier"])
    files = spark.createDataFrame([("src/utils.ts",), ("src/shared/index.ts",)], ["path"])
    got = {r["specifier"]: r["resolved"] for r in G.resolve_imports(imports, files).collect()}
    assert got == {"./utils": "src/utils.ts", "./shared": "src/shared/index.ts", "./does-not-exist": None, "react": None}


def test_claims_and_conflict(spark):
    lines = spark.createDataFrame([("docs/a.md", 1, "Refund within 24 hours."), ("docs/b.md", 1, "Refund within 48 hours."), ("docs/b.md", 2, "short"), ("docs/b.md", 3, "You should rest well.")], ["path", "line", "text"])
    claims = I.text_claims(lines)
    assert {(r["text"], r["strength"]) for r in claims.collect()} == {("Refund within 24 hours.", "must"), ("Refund within 48 hours.", "must"), ("You should rest well.", "should")}
    (f,) = I.conflicts(I.constraints(claims)).collect()
    assert (f["key"], f["a_normal"], f["b_normal"], f["tags"], f["severity"]) == ("refund", "86400s", "172800s", ["payment"], "high")
    assert abs(f["confidence"] - 0.7) < 1e-9 and abs(f["priority"] - 0.8) < 1e-9


def test_code_claims(spark):
    lines = spark.createDataFrame([("a.ts", 1, "const MAX_RETRY = 5;"), ("a.ts", 2, "if (hours > 24) {"), ("a.ts", 3, "// const NO = 1")], ["path", "line", "text"])
    assert {r["text"] for r in I.code_claims(lines).collect()} == {"MAX_RETRY = 5", "hours > 24 h"}


def test_impact(spark):
    score = G.risk_score(F.lit(2), F.lit(1), F.lit(0.0), F.lit(0), F.lit(True))
    assert spark.range(1).select(score.alias("s"), G.risk_level(score).alias("l")).first() == (21.0, "low")


def test_globs():
    import re

    assert re.search(T.glob_regex("**/*.md"), "docs/a.md") and not re.search(T.glob_regex("**/*.md"), "README.md")
    assert re.search(T.glob_regex("**/*.md", zero_dirs=True), "README.md")
    assert re.search(T.glob_regex("node_modules"), "a/node_modules/b.js") and re.search(T.glob_regex("docs/**"), "docs")
