"""Queries: single signals, joins of symbols, edges and files, clusters, seeds, candidates and guards, over parts, line items and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.functions import text as T
from marram.operators import edits as E
from marram.operators import graph as G
from marram.operators import search as S
from marram.plans.graph import EDGES, edges
from marram.plans.registry import query, read
from marram.plans.search import MADE, PATH, TOK, documents, made_paths

SYMBOLS = "s as (select p_partkey as id, concat('src/', p_brand, '.ts') as path, p_name as name, case p_partkey % 3 when 0 then 'class' when 1 then 'function' else 'method' end as kind from part)"


def symbols(spark, sf):
    """Symbols (id, path, name, kind), from part."""
    k = F.col("p_partkey") % 3
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("src/"), "p_brand", F.lit(".ts")).alias("path"), F.col("p_name").alias("name"), F.when(k == 0, "class").when(k == 1, "function").otherwise("method").alias("kind"))


@query(f"""with {EDGES}, d as (select src as node, 0 as i, 1 as o from e union all select dst, 1, 0 from e), g as (select node, sum(i) as i, sum(o) as o from d group by node)
select node, round((1 + case when node % 11 = 0 then 3.0 else greatest(0.5, 1.0 / (node % 5 + 1)) end * 2.0 + log2(i + o + 2) * 1.5) * (1 + 5 * (i / 1000.0)), 6)::double as boost from g""")
def callgraph_boost(spark, sf):
    g = G.degrees(edges(spark, sf))
    n = F.col("node")
    return g.select("node", F.round(S.call_graph_boost(n % 5, n % 11 == 0, F.col("n_in"), F.col("n_out"), F.col("n_in") / 1000), 6).alias("boost"))


@query("""select l_orderkey, round(sum(case l_returnflag || l_linestatus when 'AO' then 10.0 when 'RO' then 6.0 when 'NO' then 3.0 when 'NF' then 0.5 else 1.0 end), 6)::double as weighted from lineitem group by l_orderkey""")
def field_weights(spark, sf):
    """Line items as matches in fields; the bodies' weight for all other modes."""
    m = F.concat("l_returnflag", "l_linestatus")
    field = F.when(m == "AO", "definition").when(m == "RO", "signature").when(m == "NO", "exported").when(m == "NF", "comment").otherwise("elsewhere")
    return read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(S.field_weight(field)), 6).alias("weighted"))


@query(f"with {SYMBOLS} select path, sum(case when lower(name) = 'red widget' then 32 when contains(lower(name), 'red widget') then 16 else 0 end + case when lower(name) = 'bolt' then 32 when contains(lower(name), 'bolt') then 16 else 0 end)::bigint as symbol from s group by path")
def symbol_signal(spark, sf):
    return S.symbol_signal(symbols(spark, sf), ["Red Widget", "bolt"])


@query("select conv_id as path, sum(case when contains(lower(text), 'the') then 10 else 0 end + case when contains(lower(text), 'error') then 10 else 0 end)::bigint as comment from conversations group by conv_id")
def comment_signal(spark, sf):
    return S.comment_signal(read(spark, sf, "conversations").select(F.col("conv_id").alias("path"), "text"), ["the", "Error"])


@query("select doc_id, (100 * len(regexp_extract_all(text, 'est[a-z]+')) + 100 * len(regexp_extract_all(text, '[0-9]{3}')))::bigint as pattern from documents")
def pattern_signal(spark, sf):
    return documents(spark, sf).select("doc_id", S.pattern_signal(F.col("text"), ["est[a-z]+", "[0-9]{3}"]).cast("long").alias("pattern"))


TESTED = "f as (select distinct concat('src/', p_brand, '-', p_size, case p_partkey % 4 when 0 then '.test.ts' when 1 then '.spec.js' when 2 then '.ts' else '.js' end) as path from part)"


@query(rf"with {TESTED}, t as (select distinct regexp_replace(path, '\.(test|spec)\.', '.') as path from f where regexp_matches(path, '\.(test|spec)\.')) select path, case when path in (select path from t) then 1.0 else 0.0 end::double as tested from f")
def test_coverage_signal(spark, sf):
    end = F.element_at(F.array(*map(F.lit, [".test.ts", ".spec.js", ".ts", ".js"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return S.test_signal(read(spark, sf, "part").select(F.concat(F.lit("src/"), "p_brand", F.lit("-"), "p_size", end).alias("path")).distinct())


@query(f"with m as ({MADE}) select p_partkey, case when regexp_matches(lower(path), '\\.(csv|json|ndjson)$') or regexp_matches(split_part(lower(path), '/', -1), 'metrics?') then 2.24 else 2.0 end::double as score from m")
def metrics_boost(spark, sf):
    return made_paths(spark, sf).select("p_partkey", F.round(S.metrics_boost(F.lit(2.0), F.col("path")), 6).alias("score"))


@query("select p_partkey, case when lower(p_name) = 'red' then 1.0 when starts_with(lower(p_name), 'red') then 0.8 when contains(lower(p_name), 'red') then 0.5 else 0.0 end::double as score from part")
def seed_match(spark, sf):
    return read(spark, sf, "part").select("p_partkey", S.seed_match(F.col("p_name"), "Red").alias("score"))


@query(f"with {SYMBOLS} select id, name from s where kind in ('function', 'method') and contains(path, 'Brand#1') and (contains(lower(name), 'bolt') or contains(lower(name), 'red'))")
def symbol_seeds(spark, sf):
    """Seeds of the query `function:bolt in:Brand#1 red`."""
    q = T.seed_query("function:bolt in:Brand#1 red")
    return symbols(spark, sf).where(q.matches(F.col("name"), F.col("kind"), F.col("path"))).select("id", "name")


CLUSTERS = f"""with {EDGES}, d as (select src as node, 0 as i, 1 as o from e union all select dst, 1, 0 from e), g as (select node, sum(i) as callers, sum(o) as callees, node % 7 as family, node % 4 * 30 as colocated, node % 2 as siblings from d group by node)"""


@query(CLUSTERS + """ select node, (450 + case when callers > 0 then 300 else 0 end + case when callees > 0 then 300 else 0 end + case when family > 0 then 200 else 0 end + case when colocated > 0 then 150 else 0 end + case when siblings > 0 then 100 else 0 end)::bigint as tokens,
case when callers + callees > family and callers + callees > colocated + siblings then 'function-chain' when family >= callers + callees and family >= colocated + siblings and family > 0 then 'type-hierarchy' when colocated + siblings > 0 then 'module-boundary' else 'mixed' end as cluster,
round(0.8 + 0.05 * colocated + 0.03 * siblings - (450 + case when callers > 0 then 300 else 0 end + case when callees > 0 then 300 else 0 end + case when family > 0 then 200 else 0 end + case when colocated > 0 then 150 else 0 end + case when siblings > 0 then 100 else 0 end) / 5000.0, 6)::double as rank from g""")
def cluster_summary(spark, sf):
    """Type, estimated tokens and rank of a cluster around each node."""
    n = F.col("node")
    g = G.degrees(edges(spark, sf)).select("node", F.col("n_in").alias("callers"), F.col("n_out").alias("callees"), (n % 7).alias("family"), (n % 4 * 30).alias("colocated"), (n % 2).alias("siblings"))
    c = {k: F.col(k) for k in ("callers", "callees", "colocated", "siblings")} | {"type_family": F.col("family")}
    tokens = S.cluster_tokens(c)
    kind = S.cluster_type(F.col("callers") + F.col("callees"), F.col("family"), F.col("colocated") + F.col("siblings"))
    return g.select("node", tokens.cast("long").alias("tokens"), kind.alias("cluster"), F.round(S.cluster_rank(F.lit(0.8), F.col("colocated"), F.col("siblings"), tokens), 6).alias("rank"))


@query(f"with m as ({MADE}) select p_partkey, case when ends_with(path, '/') then 'directory' when contains(path, '/') or regexp_matches(path, '\\.[A-Za-z0-9]+$') then 'filename' else 'content' end as kind from m")
def search_type(spark, sf):
    return made_paths(spark, sf).select("p_partkey", T.search_type(F.col("path")).alias("kind"))


@query(f"with m as ({MADE}) select p_partkey, regexp_matches(path, '[\\\\/]') or len(path) >= 10 as strong from m")
def strong_query(spark, sf):
    return made_paths(spark, sf).select("p_partkey", T.strong_query(F.col("path")).alias("strong"))


HAVE = "list_filter([p_brand, p_type, case when p_size % 2 = 0 then p_name end], lambda x: x is not null)"


@query(f"""with h as (select p_partkey, {HAVE} as h, ['Brand#11', 'ECONOMY', 'red widget'] as w from part),
k as (select *, list_transform(range(1, least(len(h), len(w)) + 1), lambda i: h[i] = w[i]) as same from h), c as (select *, coalesce(list_position(same, false), 0) as f, len(list_intersect(h, w)) as shared from k)
select p_partkey, round(greatest(0, 4.0 * (case when f > 0 then f - 1 else len(same) end) / greatest(len(h), len(w)) + 1.5 * len(list_filter(same, lambda x: x)) + 3.0 * shared / (len(list_distinct(h)) + len(w) - shared) + case when h[-1] = w[-1] then 2 else 0 end - 0.5 * abs(len(h) - len(w))), 6)::double as score from c""")
def heading_path_score(spark, sf):
    have = F.filter(F.array("p_brand", "p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_name"))), lambda x: x.isNotNull())
    return read(spark, sf, "part").select("p_partkey", F.round(S.heading_path_score(have, F.array(*map(F.lit, ["Brand#11", "ECONOMY", "red widget"]))), 6).alias("score"))


@query("""select l_orderkey, l_linenumber, round(coalesce(l_discount, 0) + case l_returnflag || l_linestatus when 'AO' then 1.0 when 'RO' then 0.8 when 'NO' then 0.4 when 'NF' then 1.2 else 0.3 end, 6)::double as confidence from lineitem
order by round(coalesce(l_discount, 0) + case l_returnflag || l_linestatus when 'AO' then 1.0 when 'RO' then 0.8 when 'NO' then 0.4 when 'NF' then 1.2 else 0.3 end, 6) desc, l_discount desc, l_orderkey, l_linenumber limit 100""")
def candidate_order(spark, sf):
    """Line items as candidates with a reason, the most certain hundred."""
    m = F.concat("l_returnflag", "l_linestatus")
    reason = F.when(m == "AO", "file_search").when(m == "RO", "filename_search").when(m == "NO", "symbol_search").when(m == "NF", "explicit_path")
    c = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", F.round(S.candidate_confidence(F.col("l_discount").cast("double"), reason), 6).alias("confidence"))
    return c.orderBy(F.desc("confidence"), F.desc("l_discount"), "l_orderkey", "l_linenumber").limit(100).drop("l_discount")


@query(f"with {EDGES} select s_name as source, dst, count(*) as n from e join supplier on s_suppkey = src group by all")
def edges_with_files(spark, sf):
    """Edges with their source's file."""
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_name").alias("source"))
    return G.with_files(edges(spark, sf), s).groupBy("source", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {EDGES} select src, dst from e where not exists (select 1 from supplier where s_suppkey = dst and s_nationkey < 20)")
def unresolved_edges(spark, sf):
    """Edges whose target is no known file."""
    known = read(spark, sf, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("dst"))
    return G.unresolved(edges(spark, sf), known)


@query(f"with {SYMBOLS} select s.path, s.kind, count(*) as n, min(name) as first from s group by all")
def symbols_of_files(spark, sf):
    return G.symbols_of_files(symbols(spark, sf))


@query("""with r as (select s_suppkey as node, (s_suppkey % 50) / 50.0 as rank from supplier) select 'architecture' as kind, 'high' as severity, node::varchar as node, 0.9::double as confidence from r where rank > 0.8
union all select 'risk', 'medium', null, 0.8 from (select count(*) as n from r) where n > 20 union all select 'maintenance', 'medium', null, 0.85""")
def architecture_insights(spark, sf):
    r = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 50 / 50).alias("rank"))
    return G.insights(r, hot=6)


@query(f"""with recursive {EDGES}, r(node, depth) as (select x::bigint, 0::bigint from (values (5), (9)) v(x) union select e.dst, r.depth + 1 from r join e on e.src = r.node where r.depth < 4), b as (select node, min(depth) as depth from r group by node),
d as (select src as node, 0 as i, 1 as o from e union all select dst, 1, 0 from e), g as (select node, sum(i)::bigint as n_in, sum(o)::bigint as n_out from d group by node) select node, depth, coalesce(n_in, 0) as n_in, coalesce(n_out, 0) as n_out, depth = 0 as entry from b left join g using (node)""")
def call_signals(spark, sf):
    return G.call_signals(spark, edges(spark, sf), spark.range(5, 10, 4).toDF("node"), depth=4)


@query("select doc_id, md5(text) as md5, sha256(text) as sha256 from documents")
def content_hashes(spark, sf):
    raw = F.col("text").cast("binary")
    return documents(spark, sf).select("doc_id", F.md5(raw).alias("md5"), F.sha2(raw, 256).alias("sha256"))


@query("select doc_id, strlen(text) <= 10000 or doc_id % 5 = 0 or doc_id % 7 = 0 as allowed from documents")
def delete_guard(spark, sf):
    """Files of over 10,000 bytes go only by force (every fifth) or with the hash of their content (every seventh)."""
    h = F.sha2(F.col("text").cast("binary"), 256)
    d = documents(spark, sf).select("doc_id", E.may_delete(F.octet_length("text"), h, F.when(F.col("doc_id") % 7 == 0, h), F.col("doc_id") % 5 == 0).alias("allowed"))
    return d


@query(rf"""with n as (select {PATH} as path, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as t from documents), q as (select unnest(list_transform(range(1, 12), lambda i: substr('estiin oransh', i, 3))) as g)
select path from n where exists (select 1 from q where contains(t, g)) union select path from n where contains(lower(path), 'estiin') and contains(lower(path), 'oransh')""")
def candidate_union(spark, sf):
    """Paths that share a trigram with the keywords or are named by them."""
    return S.candidate_paths(documents(spark, sf).select("path", "text"), ["estiin", "oransh"])


@query(f"select doc_id, round(ln(len({TOK}) + 1), 6) as length_log, line_at as line_at from (select *, len(substr(text, 1, 100)) - len(replace(substr(text, 1, 100), chr(10), '')) + 1 as line_at from documents)")
def line_at_position(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", F.round(F.log(F.size(T.tokens(F.col("text"))) + 1), 6).alias("length_log"), T.line_at(F.col("text"), F.lit(100)).cast("long").alias("line_at"))
