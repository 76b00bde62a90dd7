"""Queries: degrees, traversals, PageRank, cycles, hot spots, impact, over edges between parts, suppliers, customers and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.operators import graph as G
from marram.plans.registry import query, read

#: Suppliers that share a part follow each other: 10 edges a part at most, cycles included.
EDGES = "e as (select distinct l_suppkey as src, (l_suppkey * 7 + l_partkey % 3) % 97 as dst from lineitem)"


def edges(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), ((F.col("l_suppkey") * 7 + F.col("l_partkey") % 3) % 97).alias("dst")).distinct()


def tree(spark, sf):
    """Customers to nations to regions, as one acyclic graph of numbered nodes."""
    c = read(spark, sf, "customer").select((F.col("c_custkey") + 1000).alias("src"), (F.col("c_nationkey") + 100).cast("long").alias("dst"))
    n = read(spark, sf, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    return c.unionByName(n)


TREE = "e as (select c_custkey + 1000 as src, (c_nationkey + 100)::bigint as dst from customer union all select (n_nationkey + 100)::bigint, n_regionkey::bigint from nation)"


@query(f"with {EDGES}, d as (select src as node, 0 as i, 1 as o from e union all select dst, 1, 0 from e) select node, sum(i)::bigint as n_in, sum(o)::bigint as n_out from d group by node")
def degree_counts(spark, sf):
    return G.degrees(edges(spark, sf))


@query(f"with {EDGES} select distinct dst as node, 'downstream' as direction from e where src = 5 union select distinct src, 'upstream' from e where dst = 5")
def neighbors_both(spark, sf):
    return G.neighbors(edges(spark, sf), 5)


def _bfs_sql(start: str, depth: int) -> str:
    return f"r(node, depth) as (select {start}::bigint, 0::bigint union select e.dst, r.depth + 1 from r join e on e.src = r.node where r.depth < {depth}), b as (select node, min(depth) as depth from r where node <> {start} group by node)"


@query(f"with recursive {EDGES}, {_bfs_sql('5', 20)} select node from b")
def bfs_closure(spark, sf):
    return G.bfs(spark, edges(spark, sf), spark.range(5, 6).toDF("node")).select("node")


@query(f"with recursive {EDGES}, {_bfs_sql('5', 3)} select node, depth from b")
def bfs_depth(spark, sf):
    return G.bfs(spark, edges(spark, sf), spark.range(5, 6).toDF("node"), depth=3)


@query("with e as (select distinct c_custkey as src, c_nationkey as dst from customer) select dst, count(*) as importers from e group by dst")
def reverse_imports(spark, sf):
    return G.reverse_index(read(spark, sf, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst")))


def _pagerank_sql(table: str, rounds: int) -> str:
    out = [f"{table}, o as (select src, count(*) as n from e group by src), k as (select e.src, e.dst, count(*) / any_value(o.n)::double as w from e join o using (src) group by e.src, e.dst), n as (select src as node from e union select dst from e), t as (select count(*)::double as t from n), r0 as (select node, 1 / t as rank from n, t)"]
    for i in range(rounds):
        out.append(f"g{i} as (select dst as node, sum(w * rank) as got from k join r{i} on k.src = r{i}.node group by dst), z{i} as (select coalesce(sum(rank), 0) as z from r{i} where node not in (select src from o)), r{i + 1} as materialized (select n.node, 0.15 / t + 0.85 * (coalesce(got, 0) + z / t) as rank from n left join g{i} using (node), z{i}, t)")
    return "with " + ", ".join(out)


@query(_pagerank_sql(TREE, 12) + " select node, round(rank, 6) as rank from r12")
def pagerank_12(spark, sf):
    return G.pagerank(spark, tree(spark, sf), rounds=12).select("node", F.round("rank", 6).alias("rank"))


@query(_pagerank_sql(EDGES, 20) + " select node, round(rank, 6) as rank from r20")
def pagerank_20(spark, sf):
    return G.pagerank(spark, edges(spark, sf), rounds=20).select("node", F.round("rank", 6).alias("rank"))


@query(_pagerank_sql(EDGES, 12) + " select node, case when rank >= 0.15 then 'core' when rank >= 0.08 then 'integration' when rank >= 0.04 then 'utility' else 'peripheral' end as role from r12")
def role_distribution(spark, sf):
    return G.pagerank(spark, edges(spark, sf), rounds=12).select("node", G.role(F.col("rank")).alias("role"))


SCOPED = "e as (select distinct l_suppkey as src, (l_suppkey * 7 + l_partkey % 3) % 97 as dst from lineitem where l_quantity < 25)"


@query(f"with a as ({_pagerank_sql(SCOPED, 12)} select node, rank from r12), b as ({_pagerank_sql(EDGES, 12)} select node, rank from r12) select node, round(coalesce(a.rank, 0) - coalesce(b.rank, 0), 6) as delta from a full join b using (node)")
def pagerank_delta(spark, sf):
    """Each node's rank over small orders' edges less that over all edges."""
    d = read(spark, sf, "lineitem").where("l_quantity < 25").select(F.col("l_suppkey").alias("src"), ((F.col("l_suppkey") * 7 + F.col("l_partkey") % 3) % 97).alias("dst")).distinct()
    return G.rank_delta(spark, d, edges(spark, sf))


CHAIN = "e as (select distinct o_custkey as src, case when o_custkey % 10 = 9 then o_custkey - 4 else o_custkey + 1 end as dst from orders)"


@query(f"with recursive {CHAIN}, r(a, b, d) as (select src, dst, 1 from e union select r.a, e.dst, d + 1 from r join e on e.src = r.b where d < 12) select distinct a as node from r where a = b")
def cyclic_nodes(spark, sf):
    k = F.col("o_custkey")
    e = read(spark, sf, "orders").select(k.alias("src"), F.when(k % 10 == 9, k - 4).otherwise(k + 1).alias("dst")).distinct()
    return G.cyclic_nodes(spark, e)


@query(f"""with {EDGES}, d as (select dst as node, count(*) as n from e group by dst), s as (select s_suppkey as node, concat(case s_suppkey % 4 when 0 then 'getPart' when 1 then 'PartService' when 2 then 'useParts' else 'other' end) as name, case when s_suppkey % 3 = 0 then 'class' else 'function' end as kind, s_suppkey % 11 = 0 as ix from supplier),
h as (select s.node, case when coalesce(n, 0) >= 5 then least(n / 2, 10) else 0 end + case when name <> 'other' then 3 else 0 end + case when ix then 5 else 0 end + case when kind = 'class' then 2 else 0 end as score from s left join d using (node)) select node, round(score, 6)::double as score from h where h.score > 0 order by h.score desc, node limit 30""")
def hot_spots(spark, sf):
    n_in = edges(spark, sf).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    k = F.col("s_suppkey")
    s = read(spark, sf, "supplier").select(k.alias("node"), F.element_at(F.array(*map(F.lit, ["getPart", "PartService", "useParts", "other"])), (k % 4 + 1).cast("int")).alias("name"), F.when(k % 3 == 0, "class").otherwise("function").alias("kind"), (k % 11 == 0).alias("ix"))
    d = s.join(n_in, "node", "left").select("node", G.hot_spot_score(F.coalesce("n", F.lit(0)), F.col("name"), F.col("ix"), F.col("kind")).alias("score"))
    return d.where("score > 0").orderBy(F.desc("score"), "node").limit(30)


@query(f"with {EDGES}, f as (select src, count(*) as n from e group by src), s as (select src, least(least(n * 3, 30) + least((src % 6) * 5, 20) + least((src % 3) * 10, 20) + case when src % 10 = 0 then 10 else 0 end, 100) as score from f) select src, score::double as score, case when score >= 70 then 'high' when score >= 35 then 'medium' else 'low' end as level from s")
def impact_risk(spark, sf):
    f = edges(spark, sf).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    score = G.risk_score(F.col("n"), F.col("src") % 6, F.lit(0.0), F.col("src") % 3, F.col("src") % 10 == 0)
    return f.select("src", score.alias("score"), G.risk_level(score).alias("level"))


@query("select count(*) filter (c_nationkey < 20) as resolved, count(*) filter (c_nationkey >= 20) as unresolved, round(count(*) filter (c_nationkey >= 20) / count(*)::double, 6) as ratio, case when count(*) filter (c_nationkey >= 20) = 0 then 'high' when count(*) filter (c_nationkey >= 20) / count(*)::double < 0.25 then 'medium' else 'low' end as confidence from customer")
def index_status(spark, sf):
    c = read(spark, sf, "customer")
    return G.index_status(c.where("c_nationkey < 20"), c.where("c_nationkey >= 20")).withColumn("ratio", F.round("ratio", 6))


@query("with l as (select p_partkey % 20 as k, p_partkey as x, p_size as a, p_size + 10 as b from part), r as (select s_suppkey % 20 as k, s_suppkey as y, s_suppkey % 60 as c, s_suppkey % 60 + 5 as d from supplier) select x, y from l join r using (k) where a <= d and b >= c")
def range_overlap_join(spark, sf):
    left = read(spark, sf, "part").select((F.col("p_partkey") % 20).alias("k"), F.col("p_partkey").alias("x"), F.col("p_size").alias("a"), (F.col("p_size") + 10).alias("b"))
    right = read(spark, sf, "supplier").select((F.col("s_suppkey") % 20).alias("k"), F.col("s_suppkey").alias("y"), (F.col("s_suppkey") % 60).alias("c"), (F.col("s_suppkey") % 60 + 5).alias("d"))
    return G.overlapping(left, right, "k", span=16).select("x", "y")


@query("with c as (select l_suppkey % 50 as name, l_linenumber as method, l_orderkey % 9 as path, (l_quantity % 3)::int as args, l_returnflag = 'R' as awaited from lineitem), k as (select name, method, args, count(*) as k from c group by all), u as (select name, method, max(k) as usual, arg_max(args, k * 10 - args) as arity from k group by all), s as (select name, method, count(*) as n_calls, count(distinct path) as n_files, avg(awaited::int) as awaited from c group by all) select name, method, n_calls, n_files, arity, round(awaited, 6) as awaited, case when n_calls >= 8 and n_files >= 2 and usual / n_calls::double > 0.8 then 'high' when n_calls >= 3 or n_files >= 2 and usual / n_calls::double > 0.5 then 'medium' else 'low' end as confidence from s join u using (name, method)")
def ghost_interface(spark, sf):
    c = read(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("name"), F.col("l_linenumber").alias("method"), (F.col("l_orderkey") % 9).alias("path"), (F.col("l_quantity") % 3).cast("int").alias("args"), (F.col("l_returnflag") == "R").alias("awaited"))
    return G.ghost_methods(c).withColumn("awaited", F.round("awaited", 6))


@query(f"with {EDGES}, y as (select s_suppkey as symbol, s_nationkey as path from supplier), s as (select symbol as seed, path from y), d as (select distinct seed, 'colocated' as relation, y.symbol from s join y using (path) where y.symbol <> seed union select seed, 'caller', src from s join e on e.dst = seed union select seed, 'callee', dst from s join e on e.src = seed), r as (select *, row_number() over (partition by seed, relation order by symbol) as place from d) select * from r where place <= case when relation = 'colocated' then 10 else 15 end")
def cluster_relations(spark, sf):
    y = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("path"))
    return G.clusters(y, edges(spark, sf), y.select(F.col("symbol").alias("seed")))
