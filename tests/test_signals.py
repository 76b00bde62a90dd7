"""Further signals, segments and edit helpers."""

from pyspark.sql import functions as F

from marram.operators import documents as D
from marram.operators import edits as E
from marram.operators import graph as G
from marram.operators import search as S


def test_signals(spark):
    names = spark.createDataFrame([("user",), ("userName",), ("my_user",), ("a-username",), ("other",)], ["n"])
    assert [r[0] for r in names.select(S.seed_match(F.col("n"), "user")).collect()] == [1.0, 0.8, 0.5, 0.5, 0.0]
    syms = spark.createDataFrame([("a", "user"), ("a", "UserName"), ("b", "x")], ["path", "name"])
    assert {r["path"]: r["symbol"] for r in S.symbol_signal(syms, ["user"]).collect()} == {"a": 48, "b": 0}
    files = spark.createDataFrame([("src/a.ts",), ("src/a.test.ts",), ("src/b.ts",)], ["path"])
    assert {r["path"] for r in S.test_signal(files).where("tested = 1").collect()} == {"src/a.ts"}
    assert S.budget("safe", 10, True)["files"] == 202 and S.budget("deep", 10**9, False, True)["candidates"] == 1224


def test_segments(spark):
    text = "a\nb\n\n- x\n- y\n```\ncode | z\n```\n```\nmore\n```\n| t |\n| u |\nend"
    got = D.structural_segments(D.lines(spark.createDataFrame([(1, text)], ["doc_id", "text"]))).orderBy("start_line").collect()
    assert [(r["kind"], r["start_line"], r["end_line"]) for r in got] == [("text", 1, 2), ("list", 4, 5), ("fence", 6, 8), ("fence", 9, 11), ("table", 12, 13), ("text", 14, 14)]


def test_helpers(spark):
    m = spark.createDataFrame([(1, 0, 0.95), (1, 9, 0.7), (2, 0, 0.9), (2, 5, 0.88), (3, 0, 0.5)], ["edit", "place", "confidence"])
    assert [(r["edit"], r["place"]) for r in E.unambiguous(m).collect()] == [(1, 0)]
    assert E.escape_variants("a\\nb") == ["a\\nb", "a\nb"]
    t = spark.createDataFrame([("x\ny",)], ["t"])
    assert [t.select(E.insert_at(F.col("t"), k, "n")).first()[0] for k in (1, 2, 3)] == ["n\nx\ny", "x\nn\ny", "x\ny\nn"]
    ranks = spark.createDataFrame([("a", 0.6), ("b", 0.4)], ["node", "rank"])
    assert G.mermaid(ranks, spark.createDataFrame([("a", "b"), ("b", "z")], ["src", "dst"])) == 'graph TD\n  n0["a"]\n  n1["b"]\n  n0 --> n1'
