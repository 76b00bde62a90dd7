"""Core operators over null, empty, one-character, repeated and absent rows, and zero vectors: defined results, no crash."""

import pytest
from pyspark.sql import functions as F

from marram.functions import text as T
from marram.operators import documents as D
from marram.operators import graph as G
from marram.operators import retrieval as R
from marram.operators import search as S

TEXTS = [("a", None), ("b", ""), ("c", "x"), ("d", "alpha beta"), ("d", "alpha beta"), ("e", "...\n\n"), (None, "alpha"), ("f", "alphabet " * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "path string, text string").withColumn("age_days", F.lit(3))


def test_rankings(docs):
    for q in ("alpha", "", "zz", "a"):
        for df in (S.trigram_search(docs, q, "path"), S.bm25(docs, q, "path")):
            assert all(r["score"] > 0 for r in df.collect())
            assert df.limit(0).count() == 0
    assert {r["path"] for r in S.trigram_search(docs, "alpha", "path").collect()} == {"d", "f", None}
    assert S.corpus_stats(docs.limit(0)).count() == 1


def test_fuzzy_names(spark):
    d = spark.createDataFrame([("",), (None,), ("x",), ("src/abc.ts",)], "n string")
    got = d.select("n", S.symbol_fuzzy(F.col("n"), "").alias("a"), S.filename_fuzzy(F.col("n"), "").alias("b"), S.symbol_fuzzy(F.col("n"), "x").alias("c")).collect()
    by = {r["n"]: r for r in got}
    assert by[""]["a"] == 1.0 and by["x"]["c"] == 1.0 and by[None]["a"] is None


def test_vectors(spark):
    d = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 2.0], [1.0, 2.0]), (None, [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in d.select(F.round(T.cosine(F.col("a"), F.col("b")), 6)).collect()] == [0.0, 1.0, 0.0]


def test_search_and_outline(docs):
    some = docs.where("path is not null")
    assert R.scout(some, "alpha").count() >= 1 and R.scout(some.limit(0), "alpha").count() == 0
    lines = D.lines(some.select(F.col("path").alias("doc"), "text"), "doc")
    assert D.markdown_headings(lines, "doc").count() == 0


def test_soft_priority(spark):
    rows = [(i, i % 3 == 0) for i in range(50)] + [(100, None)]
    d = spark.createDataFrame(rows, "k long, p boolean")
    got = [r["k"] for r in S.soft_priority(d, F.col("p"), [F.desc("k")], 10).collect()]
    first = [48, 45]
    assert got == first + [x for x in (100, *range(49, -1, -1)) if x not in first][:8]
    assert S.soft_priority(d.limit(0), F.col("p"), ["k"], 5).count() == 0
    assert len(S.soft_priority(d.limit(3), F.col("p"), ["k"], 10).collect()) == 3


def test_graphs(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert G.degrees(none).count() == 0 and G.cyclic_nodes(spark, none).count() == 0
    loops = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "src long, dst long")
    assert {tuple(r) for r in G.degrees(loops).collect()} == {(1, 3, 2), (2, 0, 1)}


def test_candidates(spark):
    files = spark.createDataFrame([("src/alpha.ts", "nothing"), ("b.ts", "uses alpha"), ("c.ts", None), ("d.ts", "")], "path string, text string")
    symbols = spark.createDataFrame([("d.ts", "makeAlpha"), ("c.ts", None)], "path string, name string")
    got = {r["path"] for r in S.candidate_paths(files, ["alpha"], symbols, least=0).collect()}
    assert got == {"src/alpha.ts", "b.ts", "d.ts"}
    assert S.candidate_paths(files, ["alpha"], symbols).count() == 4  # few: all paths come on top


def test_seed_query():
    q = T.seed_query(" function:load in:src/a.ts scope:project usages:x scope:other y class: ")
    assert q == T.SeedQuery(("load", "x", "y"), ("function", "method", "class"), "src/a.ts", "project", True)
    assert T.seed_query("  ") == T.SeedQuery()
