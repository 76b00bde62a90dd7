"""Queries over all the rows that their names promise."""

from marram.operators import graph as G
from marram.operators import search as S
from marram.plans import search


def test_every_similar_row_is_found(spark):
    rows = [(i, [f"w{(i * 7 + k) % 40}" for k in range(1 + i % 9)]) for i in range(60)] + [(60, []), (61, []), (5, ["w1"])]
    want = set()
    for a, x in rows:
        for b, y in rows:
            if a % 3 == 0 and a != b and set(x) | set(y) and (j := len(set(x) & set(y)) / len(set(x) | set(y))) >= 0.2:
                want.add((a, b, round(j, 6)))
    sets = spark.createDataFrame(rows, "k long, t array<string>")
    got = [(r["a"], r["b"], round(r["j"], 6)) for r in S.jaccard_search(sets.where("k % 3 = 0"), sets, "k", "t", 0.2, rows=7).collect()]
    assert len(want) > 100 and set(got) == want


def test_documents_are_compared_with_documents(spark, tmp_path):
    rows = [(100, "a b c d", "s"), (2, "d c b a e", "s"), (300, "x y z", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in search.jaccard_pairs(spark, str(tmp_path)).collect()] == [(100, 2, 0.8)]


def test_rank_delta_of_every_node(spark):
    frame = lambda e: spark.createDataFrame(e, "src long, dst long")
    scoped, whole = [(1, 2), (2, 1), (2, 3), (7, 1)], [(1, 2), (2, 1), (2, 3), (3, 4), (4, 1)]

    def ranks(edges, rounds=12):
        nodes = {n for e in edges for n in e}
        r = dict.fromkeys(nodes, 1 / len(nodes))
        out = {n: [d for s, d in edges if s == n] for n in nodes}
        for _ in range(rounds):
            loose = sum(r[n] for n in nodes if not out[n])
            r = {n: 0.15 / len(nodes) + 0.85 * (sum(r[s] / len(out[s]) for s, d in edges if d == n) + loose / len(nodes)) for n in nodes}
        return r

    a, b = ranks(scoped), ranks(whole)
    got = {r["node"]: r["delta"] for r in G.rank_delta(spark, frame(scoped), frame(whole)).collect()}
    assert got.keys() == {1, 2, 3, 4, 7} and all(abs(got[n] - (a.get(n, 0) - b.get(n, 0))) < 2e-6 for n in got)


def test_rare_terms_and_late_query_words_count(spark, tmp_path):
    spark.createDataFrame([(1, "the cat the dog", "s"), (2, "the estiin", "s"), (3, "the end", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, "q w e r t estiin")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {tuple(r) for r in search.doc_frequency(spark, str(tmp_path)).collect()} == {("the", 3), ("cat", 1), ("dog", 1), ("estiin", 1), ("end", 1)}
    assert [(r["item_id"], r["doc_id"], r["rank"]) for r in search.bm25_multiquery(spark, str(tmp_path)).collect()] == [(9, 2, 1)]


def test_nodes_between_cycles_are_on_none(spark):
    edges = [(11, 12), (12, 11), (12, 5), (5, 6), (6, 1), (1, 2), (2, 3), (3, 1), (3, 20), (20, 21), (40, 40), (40, 11)]
    got = {r["node"] for r in G.cyclic_nodes(spark, spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {11, 12, 1, 2, 3, 40}
