"""Queries: tokens and index, ranking, post-processing, vectors, predicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marram.functions import text as T
from marram.operators import search as S
from marram.plans.registry import query, read

QUERY = "the estiin oransh"
TERMS = ["the", "estiin", "oransh"]
TOK = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
NORM = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
PATH = "concat('docs/', source, '/', doc_id, '.txt')"
BM25_SQL = f"""
with d as (select *, {TOK} as t from documents),
l as (select *, len(t) as n from d),
q as (select unnest(['the', 'estiin', 'oransh']) as term),
s as (select count(*) as c, avg(n) as a from l),
tf as (select l.doc_id, l.source, l.n, q.term, len(list_filter(l.t, lambda x: x = q.term)) as tf from l, q),
df as (select term, count(*) filter (tf > 0) as df from tf group by term),
bm as (select doc_id, any_value(source) as source, sum(case when tf > 0 then ln((c - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(n, 1) / a)) else 0 end) as score
  from tf join df using (term), s group by doc_id having max(tf) > 0)
"""


def documents(spark, sf):
    return read(spark, sf, "documents").withColumn("path", F.concat(F.lit("docs/"), "source", F.lit("/"), "doc_id", F.lit(".txt")))


@query(f"select doc_id, len({TOK})::bigint as n_tokens, len(list_distinct({TOK}))::bigint as n_distinct from documents")
def tokenize_counts(spark, sf):
    t = documents(spark, sf).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"""with n as (select {NORM} as t from documents), g as (select unnest(list_transform(range(1, len(t) - 1), lambda i: substr(t, i, 3))) as trigram from n where len(t) >= 3)
select trigram, count(*) as n from g group by trigram order by n desc, trigram limit 50""")
def trigram_counts_topk(spark, sf):
    return S.trigram_counts(documents(spark, sf)).orderBy(F.desc("n"), "trigram").limit(50)


@query(f"""with n as (select doc_id, {NORM} as t from documents), g as (select doc_id, list_transform(range(1, len(t) - 1), lambda i: substr(t, i, 3)) as g from n where len(t) >= 3),
q as (select unnest(list_transform(range(1, 16), lambda i: substr('the estiin oransh', i, 3))) as x),
s as (select doc_id, sum(len(list_filter(g, lambda y: y = x))) / any_value(len(list_distinct(g))) as score from g, q group by doc_id)
select doc_id, round(score, 6) as score from s where score > 0 order by s.score desc, doc_id limit 20""")
def trigram_search(spark, sf):
    return S.trigram_search(documents(spark, sf), QUERY).orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


@query(f"with p as (select doc_id, unnest(list_distinct({TOK})) as term from documents) select term, count(*) as df from p group by term")
def doc_frequency(spark, sf):
    return S.postings(documents(spark, sf)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"select count(*) as n_docs, round(avg(len({TOK})), 6) as avgdl from documents")
def corpus_stats(spark, sf):
    return S.corpus_stats(documents(spark, sf)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(BM25_SQL + "select doc_id, round(score, 6) as score, row_number() over (order by score desc, doc_id) as rank from bm order by rank limit 10")
def bm25_topk(spark, sf):
    return S.top_k(S.bm25(documents(spark, sf), QUERY), 10).select("doc_id", F.round("score", 6).alias("score"), "rank")


@query(BM25_SQL.replace("'estiin', 'oransh'", "'1', 'docs'").replace("'the'", "'the'") + f""", m as (select doc_id, {PATH} as path, score from bm),
f as (select *, case when lower(split_part(path, '/', 3)) in ('the', '1', 'docs') or regexp_replace(lower(split_part(path, '/', 3)), '\\.[^.]*$', '') in ('the', '1', 'docs') then 10.0 when contains(split_part(path, '/', 3), 'the') or contains(split_part(path, '/', 3), '1') or contains(split_part(path, '/', 3), 'docs') then 5.0 else 1.0 end as boost from m)
select path, round(score * boost / 3.0, 6) as score from f order by score * boost / 3.0 desc, path limit 20""")
def bm25_filename_depth(spark, sf):
    d = S.bm25(documents(spark, sf), "the 1 docs", keep=["path"])
    total = F.col("score") * S.filename_multiplier(F.col("path"), ["the", "1", "docs"]) * S.depth_multiplier(F.col("path"))
    return d.withColumn("score", total).orderBy(F.desc("score"), "path").limit(20).select("path", F.round("score", 6).alias("score"))


@query(f"""with d as (select doc_id, {TOK} as t from documents), l as (select *, len(t) as n from d), s as (select count(*) as c, avg(n) as a from l),
p as (select doc_id, n, unnest(t) as term from l), tf as (select doc_id, any_value(n) as n, term, count(*) as tf from p group by doc_id, term), df as (select term, count(*) as df from tf group by term),
q as (select item_id, unnest({TOK}) as term from benchmark),
b as (select item_id, doc_id, sum(ln((c - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(n, 1) / a))) as score from q join tf using (term) join df using (term), s group by item_id, doc_id),
r as (select *, row_number() over (partition by item_id order by round(score, 6) desc, doc_id) as rank from b) select item_id, doc_id, round(score, 6) as score, rank from r where rank <= 3""")
def bm25_multiquery(spark, sf):
    """All tokens of each item, repeats counted."""
    q = read(spark, sf, "benchmark").select("item_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return S.bm25_best(documents(spark, sf), q, 3).select("item_id", "doc_id", "score", "rank")


@query(BM25_SQL + f""", m as (select bm.doc_id, {PATH.replace('source', 'bm.source').replace('doc_id', 'bm.doc_id')} as path, bm.score, len(string_split_regex(d.text, '\\r?\\n')) as lines, d.n_chars, len(list_filter(string_split_regex(d.text, '\\r?\\n'), lambda x: regexp_matches(x, '(?i)(the|estiin|oransh)'))) as hits from bm join documents d using (doc_id)),
sig as (select doc_id, case when lines > 1000 then 0.9 else 1.0 end * least(greatest(score / 100, 0), 1) as content, score, hits, case when doc_id % 100 < 7 then 1.0 when doc_id % 100 < 30 then 0.8 when doc_id % 100 < 90 then 0.6 else 0.4 end as recency from m),
tot as (select doc_id, content, recency, (content * 0.30 + recency * 0.05 + least(1.0, log2(2) / 7) * 0.10) * 100 as total, score, hits from sig)
select doc_id, round(content, 6) as content, recency::double as recency, round(case when hits > 0 and total < 10 then 10 + score / 100 else total end, 6) as total from tot""")
def hybrid_score(spark, sf):
    d = documents(spark, sf)
    hits = F.size(F.filter(F.split("text", "\r?\n"), lambda x: x.rlike("(?i)(the|estiin|oransh)")))
    b = S.bm25(d.withColumn("lines", T.line_count(F.col("text"))).withColumn("hits", hits), QUERY, keep=["path", "lines", "hits"])
    signals = {
        "content": S.normalized_signal(F.col("score"), 100, F.col("lines")),
        "filename": S.normalized_signal(S.filename_signal(F.col("path"), TERMS), 100),
        "recency": S.recency_signal(F.col("doc_id") % 100),
        "outbound": S.outbound_signal(F.lit(0)),
    }
    total = S.hybrid_total("code", signals, F.col("score"), F.col("hits"))
    return b.select("doc_id", F.round(signals["content"], 6).alias("content"), signals["recency"].alias("recency"), F.round(total, 6).alias("total"))


@query("""with s as (select p_partkey, lower(p_name) as n, 'red widgets' as q from part), t as (select *, 1 - levenshtein(n, q) / greatest(len(n), len(q))::double as sim from s),
u as (select p_partkey, case when n = q then 1.0 when starts_with(n, q) then 0.8 when contains(n, q) then 0.6 when sim > 0.7 then sim * 50 / 100 else 0 end as score from t) select p_partkey, round(score, 6) as score from u where score > 0 order by u.score desc, p_partkey limit 100""")
def filename_fuzzy(spark, sf):
    return read(spark, sf, "part").select("p_partkey", S.filename_fuzzy(F.col("p_name"), "red widgets").alias("s")).where("s > 0").orderBy(F.desc("s"), "p_partkey").limit(100).select("p_partkey", F.round("s", 6).alias("score"))


@query("select p_partkey, p_name from part where p_name ilike '%Bolt%' order by p_name, p_partkey limit 100")
def symbol_like(spark, sf):
    return read(spark, sf, "part").where(F.col("p_name").ilike("%Bolt%")).select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(100)


@query("""with s as (select c_custkey, lower(c_name) as n, lower('Customer#000000100') as q from customer), t as (select *, levenshtein(n, q) as d from s),
u as (select c_custkey, least(1.0, 1 - d / greatest(len(n), len(q))::double + case when starts_with(n, q) then 0.2 else 0 end + case when n = q then 0.3 else 0 end) as score from t where d <= 2) select c_custkey, round(score, 6) as score from u order by u.score desc, c_custkey limit 100""")
def symbol_fuzzy_lev2(spark, sf):
    s = read(spark, sf, "customer").select("c_custkey", S.symbol_fuzzy(F.col("c_name"), "Customer#000000100").alias("s")).where("s is not null")
    return s.orderBy(F.desc("s"), "c_custkey").limit(100).select("c_custkey", F.round("s", 6).alias("score"))


@query("""with a as (select o_orderkey, date_diff('day', o_orderdate::date, date '1998-08-02') as age from orders) select case when age < 7 then 1.0 when age < 30 then 0.8 when age < 90 then 0.6 else 0.4 end::double as recency, count(*) as n from a group by 1""")
def recency_bucket(spark, sf):
    age = F.datediff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date"))
    return read(spark, sf, "orders").select(S.recency_signal(age).alias("recency")).groupBy("recency").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, round(least(greatest(n_chars / 2000.0, 0), 1) * case when len(string_split_regex(text, '\\r?\\n')) > 1000 then 0.9 else 1 end, 6)::double as signal from documents")
def normalize_signals(spark, sf):
    return documents(spark, sf).select("doc_id", F.round(S.normalized_signal(F.col("n_chars"), 2000.0, T.line_count(F.col("text"))), 6).alias("signal"))


@query("""with l as (select concat('docs/', source) as path, doc_id as line, substr(text, 1, 40) as preview, (n_chars % 97)::double as score from documents),
r as (select *, row_number() over (partition by path order by score desc, line) as k, count(*) over (partition by path) as n from l) select path, score, preview, n from r where k = 1""")
def group_by_file(spark, sf):
    m = documents(spark, sf).select(F.concat(F.lit("docs/"), "source").alias("path"), F.col("doc_id").alias("line"), F.substring("text", 1, 40).alias("preview"), (F.col("n_chars") % 97).cast("double").alias("score"))
    return S.best_by_file(m)


@query("with r as (select doc_id, n_chars, row_number() over (partition by text order by n_chars % 97 desc, doc_id) as k from documents) select doc_id, n_chars from r where k = 1")
def dedupe_preview(spark, sf):
    d = documents(spark, sf).withColumn("key", F.sha2("text", 256))  # rows are told apart by hash, so whole texts aren't shuffled
    return S.first_by(d.select("doc_id", "n_chars", "key"), ["key"], [F.desc(F.col("n_chars") % 97), "doc_id"]).select("doc_id", "n_chars")


@query("select doc_id, case when len(text) > 240 then concat(substr(text, 1, 239), '…') else text end as snippet from documents")
def snippet_truncate(spark, sf):
    return documents(spark, sf).select("doc_id", T.truncated(F.col("text"), 240).alias("snippet"))


@query("with s as (select doc_id, source, least(n_chars, 240) as n, sum(least(n_chars, 240)) over (partition by source order by doc_id) as upto, row_number() over (partition by source order by doc_id) as k from documents) select source, doc_id, n::bigint as n from s where upto <= 2200 and k <= 12")
def char_budget_prefix(spark, sf):
    d = documents(spark, sf).select("source", "doc_id", F.least("n_chars", F.lit(240)).alias("n"))
    return S.within_budget(d, F.col("n"), ["doc_id"], 2200, by=["source"], rows=12).withColumn("n", F.col("n").cast("long"))


@query("""with d as (select doc_id, n_chars, lang = 'de' as p from documents), q as (select *, row_number() over (partition by p order by n_chars desc, doc_id) as k from d)
select doc_id, n_chars from q order by (p and k <= 10) desc, n_chars desc, doc_id limit 50""")
def soft_priority_select(spark, sf):
    d = documents(spark, sf).select("doc_id", "n_chars", "lang")
    return S.soft_priority(d, F.col("lang") == "de", [F.desc("n_chars"), "doc_id"], 50).select("doc_id", "n_chars")


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id limit 10 offset 20")
def cursor_page(spark, sf):
    return documents(spark, sf).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(20).limit(10)


@query(f"""with t as (select doc_id, unnest({TOK}) as tok from documents),
h as (select doc_id, list_reduce(list_transform(string_split(tok, ''), lambda c: ascii(c)::ubigint), lambda h, x: (xor(h, x) * 16777619) & 4294967295, 2166136261::ubigint)::bigint as h from t)
select doc_id, (h % 64)::int as dim, sum(case when h % 2 = 0 then 1 else -1 end)::bigint as value from h group by doc_id, h % 64""")
def hash_embed(spark, sf):
    h = documents(spark, sf).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("tok")).select("doc_id", T.fnv1a(F.col("tok")).alias("h"))
    return h.groupBy("doc_id", (F.col("h") % 64).cast("int").alias("dim")).agg(F.sum(F.when(F.col("h") % 2 == 0, 1).otherwise(-1)).alias("value"))


NORMS = "sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))"
COS = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i]::double)) / (a.n * b.n)"


@query(f"""with e as (select *, {NORMS} as n from embeddings), q as (select * from e where vec_id % 100 = 0), s as (select a.vec_id as query, b.vec_id, {COS} as cos from q a, e b where a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query order by round(cos, 6) desc, vec_id) as rank from s) select query, vec_id, round(cos, 6) as cos, rank from r where rank <= 5""")
def cosine_topk(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", "embedding")
    return S.cosine_search(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)


@query(f"select vec_id, round({NORMS}, 6) as norm from embeddings")
def l2_norm(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.round(T.l2_norm(F.col("embedding")), 6).alias("norm"))


@query("""with a as (select vec_id, row_number() over (order by embedding[1]::double desc, vec_id) as rank from embeddings), b as (select vec_id, row_number() over (order by embedding[2]::double desc, vec_id) as rank from embeddings),
u as (select * from a where rank <= 200 union all select * from b where rank <= 200) select vec_id, round(sum(1.0 / (60 + rank)), 6)::double as rrf from u group by vec_id""")
def rrf_fusion(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    a, b = (S.top_k(e.select("vec_id", F.col(c).alias("score")), 200, tie="vec_id") for c in "xy")
    return S.reciprocal_rank_fusion(a, b, "vec_id").select("vec_id", F.round("rrf", 6).alias("rrf"))


@query(f"""with t as (select doc_id, list_distinct({TOK}) as t from documents), p as (select a.doc_id as a, b.doc_id as b, len(list_intersect(a.t, b.t)) as c, len(a.t) as m, len(b.t) as n from t a join t b on a.doc_id <> b.doc_id where a.doc_id % 100 = 0 and len(a.t) >= 0.2 * len(b.t) and len(b.t) >= 0.2 * len(a.t))
select a, b, round(c / (m + n - c)::double, 6) as j from p where m + n > c and c / (m + n - c)::double >= 0.2""")
def jaccard_pairs(spark, sf):
    """Each document whose id is divisible by 100 against all others, in blocks."""
    t = documents(spark, sf).select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    return S.jaccard_search(t.where("doc_id % 100 = 0"), t, "doc_id", "t", 0.2).select("a", "b", F.round("j", 6).alias("j"))


@query()
def mmr_select(spark, sf):
    e = read(spark, sf, "embeddings").withColumn("rel", F.col("embedding")[0].cast("double"))
    return S.maximal_marginal_relevance(e, "label", "vec_id", "rel", "embedding")


@query(f"with d as (select {PATH} as path from documents) select path from d where regexp_matches(path, '^docs/src1[^/]*/[^/]*\\.txt$') and not regexp_matches(path, '^.*/[^/]*7\\.txt$') or regexp_matches(path, '^docs/src1[^/]*/[^/]*\\.txt$')")
def glob_filter(spark, sf):
    return documents(spark, sf).select("path").where(T.path_filter(F.col("path"), ["docs/src1*/*.txt"], ["**/*7.txt"]))


INTENT_SQL = " ".join(f"when regexp_matches(lower(text), '{'|'.join(w)}') then '{k}'" for k, w in T.INTENT_WORDS.items())


@query(f"select conv_id, turn, case {INTENT_SQL} else 'code' end as intent from conversations where role = 'user'")
def query_intent(spark, sf):
    return read(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", T.query_intent(F.col("text")).alias("intent"))


@query(r"""select conv_id, turn, len(text)::bigint as length, len(list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> ''))::bigint as n_tokens,
regexp_matches(text, '[\\/]') or regexp_matches(text, '\.[A-Za-z0-9]+$') as has_path, regexp_matches(text, '\b[A-Za-z_$][A-Za-z0-9_$]*\b') and regexp_matches(text, '[A-Z_]') as has_symbol from conversations""")
def query_metrics(spark, sf):
    t = F.col("text")
    n = F.size(F.filter(F.split(t, "[ \\t\\r\\n]+"), lambda x: x != ""))
    return read(spark, sf, "conversations").select("conv_id", "turn", F.length(t).cast("long").alias("length"), n.cast("long").alias("n_tokens"), T.has_path(t).alias("has_path"), T.has_symbol_hint(t).alias("has_symbol"))


ROUTE_SQL = " ".join(rf"when regexp_matches(lower(text), '\b({w})\b') then '{k}'" for k, w in T.ROUTES)


@query(f"select conv_id, turn, case {ROUTE_SQL} else 'understand' end as route from conversations")
def intent_route(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", T.intent_route(F.col("text")).alias("route"))


MADE = """select p_partkey, concat(case p_partkey % 6 when 0 then '.ssh/' when 1 then 'docs/' when 2 then 'logs/' when 3 then 'src/docs/' when 4 then 'metrics/' else 'docs/adr/' end, 'f', p_size, case p_partkey % 7 when 0 then '.pem' when 1 then '.md' when 2 then '.log' when 3 then '.csv' when 4 then '.ts' when 5 then '.png' else '.JSON' end) as path from part"""


def made_paths(spark, sf):
    """Paths of many kinds, from part."""
    d = F.element_at(F.array(*map(F.lit, [".ssh/", "docs/", "logs/", "src/docs/", "metrics/", "docs/adr/"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    e = F.element_at(F.array(*map(F.lit, [".pem", ".md", ".log", ".csv", ".ts", ".png", ".JSON"])), (F.col("p_partkey") % 7 + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", F.concat(d, F.lit("f"), "p_size", e).alias("path"))


@query(f"with m as ({MADE}) select p_partkey, starts_with(path, '.ssh/') or ends_with(path, '.pem') as sensitive, ends_with(path, '.png') as is_binary from m")
def sensitive_paths(spark, sf):
    return made_paths(spark, sf).select("p_partkey", T.is_sensitive(F.col("path")).alias("sensitive"), T.is_binary(F.col("path")).alias("is_binary"))


@query(f"with m as ({MADE}) select p_partkey, ends_with(path, '.md') and contains(path, 'docs/') as docs, ends_with(path, '.md') or ends_with(path, '.log') as project_logs from m")
def doc_scope(spark, sf):
    return made_paths(spark, sf).select("p_partkey", T.in_scope(F.col("path"), "docs").alias("docs"), (T.is_markdown(F.col("path")) | F.lower("path").rlike(r"\.log$")).alias("project_logs"))


@query(f"""with m as ({MADE}) select p_partkey, case when ends_with(path, '.log') then 'logs' when regexp_matches(lower(path), '\\.(csv|json)$') and regexp_matches(path, '(^|/)metrics/') then 'metrics' when starts_with(path, 'docs/adr/') then 'adr' else 'docs' end as source_type,
case when regexp_matches(path, '\\.md$') then 'docs' when regexp_matches(lower(path), '\\.(ts|json)$') then 'code' else 'assets' end as link, case when ends_with(lower(path), '.json') then 'other' end as config from m""")
def source_type(spark, sf):
    p = F.col("path")
    return made_paths(spark, sf).select("p_partkey", T.source_type(p).alias("source_type"), T.link_category(p).alias("link"), T.config_type(p).alias("config"))


@query("with l as (select doc_id, string_split_regex(text, '\\r?\\n') as l from documents), u as (select doc_id, unnest(range(1, len(l) + 1))::bigint as line, unnest(l) as text from l), r as (select *, row_number() over (partition by doc_id order by line) as k from u where regexp_matches(text, '(?i)retitioning')) select doc_id, line, text from r where k <= 10")
def keyword_lines(spark, sf):
    return S.line_matches(documents(spark, sf), "(?i)retitioning")


@query(f"""with d as (select doc_id, text, {TOK} as t from documents) select doc_id, (case when contains(lower(text), 'the') then 1 else 0 end + case when contains(lower(text), 'estiin') then 1 else 0 end + case when contains(lower(text), 'oransh') then 1 else 0 end)::bigint as hits from d order by hits desc, doc_id limit 400""")
def quick_prefilter(spark, sf):
    hits = sum((F.contains(F.lower("text"), F.lit(t)).cast("long") for t in TERMS), F.lit(0).cast("long"))
    return documents(spark, sf).select("doc_id", hits.alias("hits")).orderBy(F.desc("hits"), "doc_id").limit(400)
