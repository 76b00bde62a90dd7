"""Queries: whole retrieval pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.operators import retrieval as R
from marram.plans.registry import query
from marram.plans.search import BM25_SQL, QUERY, documents


@query(BM25_SQL + r""", m as (select concat('docs/', d.source, '/', d.doc_id, '.txt') as path, bm.score, list_filter(string_split_regex(d.text, '\r?\n'), lambda x: regexp_matches(x, '(?i)(the|estiin|oransh)')) as h, len(string_split_regex(d.text, '\r?\n')) as lines, d.doc_id % 100 as age from bm join documents d using (doc_id)),
cand as (select * from m order by score desc, path limit 800),
sc as (select path, score, least(len(h), 10) as hits, case when len(coalesce(h[1], '')) > 240 then concat(substr(h[1], 1, 239), '…') else coalesce(h[1], '') end as preview, (case when lines > 1000 then 0.9 else 1.0 end * least(greatest(score / 100, 0), 1) * 0.30 + case when age < 7 then 1.0 when age < 30 then 0.8 when age < 90 then 0.6 else 0.4 end * 0.05 + log2(2) / 7 * 0.10) * 100 as t from cand),
tt as (select *, case when hits > 0 and t < 10 then 10 + score / 100 else t end as total from sc where hits > 0),
dd as (select * from tt qualify row_number() over (partition by case when preview <> '' then preview else path end order by total desc, path) = 1)
select path, round(total, 6) as score, hits::bigint as matches, preview, row_number() over (order by total desc, path) as rank from dd order by rank limit 20""")
def scout_search(spark, sf):
    d = documents(spark, sf).select("path", "text", (F.col("doc_id") % 100).alias("age_days"))
    return R.scout(d, QUERY).withColumn("score", F.round("score", 6))


@query(BM25_SQL + r""", m as (select d.doc_id, concat('docs/', d.source, '/', d.doc_id, '.txt') as path, coalesce(bm.score, 0) as score, list_filter(string_split_regex(d.text, '\r?\n'), lambda x: regexp_matches(x, '(?i)(the|estiin|oransh)')) as h, len(string_split_regex(d.text, '\r?\n')) as lines, d.doc_id % 100 as age from documents d left join bm using (doc_id)),
g as (select *, case when doc_id % 50 = 0 then 48.0 when doc_id % 50 = 1 then 16.0 else 0.0 end as symbol, case when doc_id % 20 = 0 then 20.0 else 0.0 end as comment, case when doc_id < 10 then (select count(*) from documents x where x.doc_id % 10 = m.doc_id) else 0 end as n_in from m),
cand as (select * from g where score > 0 or len(h) > 0 or symbol > 0 order by symbol > 0 desc, score desc, path limit 800),
sc as (select path, score, symbol, least(len(h), 10) as hits, case when len(coalesce(h[1], '')) > 240 then concat(substr(h[1], 1, 239), '…') else coalesce(h[1], '') end as preview, (case when lines > 1000 then 0.9 else 1.0 end * least(greatest(score / 100, 0), 1) * 0.15 + symbol / 100 * 0.40 + comment / 100 * 0.10 + case when age < 7 then 1.0 when age < 30 then 0.8 when age < 90 then 0.6 else 0.4 end * 0.05 + least(1.0, log2(greatest(1, n_in) + 1) / 7) * 0.10) * 100 as t from cand),
tt as (select *, case when hits > 0 and t < 10 then 10 + score / 100 else t end as total from sc where hits > 0 or symbol > 0),
dd as (select * from tt qualify row_number() over (partition by case when preview <> '' then preview else path end order by total desc, path) = 1)
select path, round(total, 6) as score, hits::bigint as matches, preview, row_number() over (order by total desc, path) as rank from dd order by rank limit 20""")
def scout_signals(spark, sf):
    """All signals: symbols and comments of some documents, and an edge from each document to one of the first ten."""
    d = documents(spark, sf)
    k = F.col("doc_id")
    files = d.select("path", "text", (k % 100).alias("age_days"))
    names = F.when(k % 50 == 0, F.array(F.lit("estiin"), F.lit("anOranshThing"))).otherwise(F.array(F.lit("theThing")))
    symbols = d.where("doc_id % 50 in (0, 1)").select("path", F.explode(names).alias("name"))
    comments = d.where("doc_id % 20 = 0").select("path", F.lit("the Oransh").alias("text"))
    targets = d.where("doc_id < 10").select(k.alias("t"), F.col("path").alias("dst"))
    edges = d.select(F.col("path").alias("src"), (k % 10).alias("t")).join(F.broadcast(targets), "t").select("src", "dst")
    return R.scout(files, QUERY, R.ScoutOptions(intent="symbol"), symbols=symbols, comments=comments, edges=edges).withColumn("score", F.round("score", 6))


@query()
def doc_search(spark, sf):
    return R.doc_search(documents(spark, sf).select("path", "text"), QUERY)
