"""What grows with the square of a group must be results only: rows that the plans make, and results over hot keys."""

import inspect
import math

from pyspark.sql import functions as F

from marram.functions import text as T
from marram.operators import graph as G
from marram.operators import search as S

SMALL = {k: v for k, v in {"rows": 40, "packed": 16}.items() if k in inspect.signature(G.overlapping).parameters}


def rows_made(spark, df):
    """The result, and the most rows that any operator of its plan put out."""
    got = [tuple(r) for r in df.collect()]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last()
    values, made = store.executionMetrics(last.executionId()), [0]
    for i in range(last.metrics().size()):
        m = last.metrics().apply(i)
        if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
            made.append(int(values.apply(m.accumulatorId()).split("\n")[-1].split(" ")[0].replace(",", "")))
    return got, max(made)


def test_clusters_of_a_large_file(spark):
    n = 2000
    symbols = spark.createDataFrame([(i, "one") for i in range(n)] + [(n, "two"), (0, "two"), (5, None)], "symbol long, path string")
    edges = spark.createDataFrame([(i, 7) for i in range(n)] + [(3, 4), (3, 4)], "src long, dst long")
    seeds = symbols.selectExpr("symbol as seed").distinct()
    got, made = rows_made(spark, G.clusters(symbols, edges, seeds))
    assert made < 40 * n
    of = lambda s, r: [x[2] for x in sorted(got, key=lambda x: x[3]) if x[:2] == (s, r)]
    assert of(100, "colocated") == list(range(10)) and of(3, "colocated") == [0, 1, 2, *range(4, 11)] and of(n, "colocated") == [0]
    assert of(0, "colocated") == list(range(1, 11)) and of(7, "caller") == list(range(15)) and of(3, "callee") == [4, 7]
    assert {x[3] for x in got if x[:2] == (7, "caller")} == set(range(1, 16))


def test_overlaps_of_a_hot_key(spark):
    lefts = [(1, i, i % 90, i % 90 + 10) for i in range(600)] + [(1, 1, 1, 11), (2, 9, 8, 3), (3, 5, None, 4), (None, 1, 1, 2), (4, 6, 0, 0)]
    rights = [(1, i, i % 30, i % 30 + 4) for i in range(200)] + [(1, 7, 7, 11)] * 40 + [(2, 8, 2, 9), (2, 7, 9, 2), (3, 1, 0, None), (None, 1, 1, 2), (4, 4, 0, 300), (4, 5, 1, 2)]
    want = sorted((k, x, y) for k, x, a, b in lefts for j, y, c, d in rights if k is not None and k == j and None not in (a, b, c, d) and a <= d and b >= c)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = G.overlapping(spark.createDataFrame(lefts, "k int, x int, a int, b int"), spark.createDataFrame(rights, "k int, y int, c int, d int"), "k", span=200, **SMALL)
        assert df.columns == ["k", "x", "a", "b", "y", "c", "d"]
        assert sorted(tuple(r) for r in df.select("k", "x", "y").collect()) == want
        shares = [r["count"] for r in df.where("k = 1").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert max(shares) < 0.6 * sum(shares)


def test_similar_sets_are_counted_in_blocks(spark):
    rows = [(i, [f"w{(i * i + j * 11) % (97 if j % 3 else 9)}" for j in range(2 + i % 14)]) for i in range(500)]
    sets = spark.createDataFrame(rows, "k long, t array<string>")
    df = S.jaccard_search(sets.where("k % 5 = 0"), sets, "k", "t", 0.5)
    assert "array_intersect" not in df._jdf.queryExecution().toString()
    got, made = rows_made(spark, df)
    of = {k: set(t) for k, t in rows}
    want = {(a, b, round(j, 9)) for a in range(0, 500, 5) for b in of if a != b and (j := len(of[a] & of[b]) / len(of[a] | of[b])) >= 0.5}
    assert {(a, b, round(j, 9)) for a, b, j in got} == want and len(got) == len(want) > 500
    assert made <= len(want) < 0.2 * 100 * 500


def test_nearest_vectors_in_blocks(spark):
    rows = [(i, [float((i * 7 + d * d) % 11 - 5) for d in range(8)], 0) for i in range(700)]
    rows += [(700, [0.0] * 8, 0), (701, None, 0), (702, [1.0, 2.0], 0), (702, [1.0, 2.0], 0), (703, [1.0, None, 3.0], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, made = rows_made(spark, S.cosine_search(d.where("vec_id % 100 = 0 or vec_id > 699"), d, "vec_id", "embedding", 5))
    padded = [(i, [x or 0.0 for x in (v or [])] + [0.0] * (8 - len(v or []))) for i, v, _ in rows]

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6) if n > 0 else 0.0

    want = []
    for q, a in padded:
        if q % 100 == 0 or q > 699:
            want.append((q, sorted((-cos(a, b), i) for i, b in padded if i != q)[:5]))
    assert sorted((q, i, c) for q, i, c, _ in got if q != 702) == sorted((q, i, -c) for q, w in want if q != 702 for c, i in w)
    assert len([r for r in got if r[0] == 702]) == 5 and all(1 <= r[3] <= 5 for r in got)
    assert made < 2 * len(rows)


def test_shared_trigrams_are_those_that_score(spark):
    texts = [None, "", "ab", "Al", "x al!!PH y", "a lph", "  bet ", "beta", "é al", "alpha-BE", "pha be", "a", "h", "a b", "lpK a"]
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [(None, "alpha")], "path string, text string")
    for q in ("alpha beta", "Al", "é alp", "a  b", "", "h a"):
        want = sorted(str(r["path"]) for r in S.trigram_search(d, q, "path").collect())
        assert sorted(str(r["path"]) for r in S.sharing_trigrams(d, q).collect()) == want
    assert "slice(" not in S.sharing_trigrams(d, "alpha beta")._jdf.queryExecution().toString()


def test_trigrams_are_counted_in_place(spark):
    texts = [None, "", "a", "ab", "abc", "Ab--c", " --x y z!!", "ééé", "Kab", "é", "abcab", "c", "\U0001f600a béc", "a1 " * 500, None]
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = d.select(F.explode(T.trigrams(F.col("text"))).alias("g")).groupBy("g").count()
    got, made = rows_made(spark, S.trigram_counts(d))
    assert dict(got) == {r["g"]: r["count"] for r in want.collect()} and made < 100
    assert S.trigram_counts(d.limit(0)).count() == 0


def test_best_documents_of_many_queries(spark):
    docs = [(i, " ".join(f"w{(i * j + j * j) % 37}" for j in range(3 + i % 40))) for i in range(400)] + [(400, None), (401, ""), (402, "..."), (403, "W1 é w1")]
    asked = [(q, f"w{(q * 5 + j * j) % 45}") for q in range(30) for j in range(1 + q % 6)] + [(30, "none"), (31, None)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "item_id long, term string")
    want = S.ranked(S.bm25_batch(d, q).withColumn("score", F.round("score", 6)), by=["item_id"]).where("rank <= 3").select("item_id", "doc_id", "score", "rank")
    for most in (500, 7):
        got, made = rows_made(spark, S.bm25_best(d, q, 3, most=most))
        assert sorted(got) == sorted(tuple(r) for r in want.collect()) and len(got) > 80
        assert made <= 32 * 3 * 8
