"""Queries: upserts, pruning, retention, change streams and bursts, over events, orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.operators import tables as U
from marram.plans.registry import query, read
from marram.streaming import changes as C

CHANGES = "c as (select user_id as path, case event_type when 'signup' then 'add' when 'error' then 'unlink' else 'change' end as kind, ts, event_id from events)"


def changes(spark, sf):
    return C.from_events(read(spark, sf, "events"))


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def upsert_latest(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return U.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("select c_custkey, c_acctbal from customer where c_nationkey not in (select c_nationkey from customer where c_nationkey < 5) union all select c_custkey, 0.0::double from customer where c_nationkey < 5")
def replace_by_key(spark, sf):
    c = read(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return U.replace_by_key(c, c.where("c_nationkey < 5").withColumn("c_acctbal", F.lit(0.0)), ["c_nationkey"]).drop("c_nationkey")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def prune_missing(spark, sf):
    return U.prune_missing(read(spark, sf, "customer").select("c_custkey"), read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("with a as (select c_custkey as k, c_nationkey as v from customer where c_custkey % 5 <> 0), b as (select c_custkey as k, case when c_custkey % 7 = 0 then c_nationkey + 1 else c_nationkey end as v from customer where c_custkey % 3 <> 0) select k, case when a.v is null then 'added' when b.v is null then 'vanished' when a.v = b.v then 'unchanged' else 'changed' end as state from a full join b using (k)")
def reconcile_index(spark, sf):
    c, k = read(spark, sf, "customer"), F.col("c_custkey")
    a = c.where(k % 5 != 0).select(k.alias("k"), F.col("c_nationkey").alias("v"))
    b = c.where(k % 3 != 0).select(k.alias("k"), F.when(k % 7 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("v"))
    return U.reconcile(a, b, "k", "v")


@query("select o_orderkey from orders where o_orderdate > timestamp '1996-01-01'")
def ttl_prune(spark, sf):
    return U.prune_expired(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", F.lit("1996-01-01").cast("timestamp")).select("o_orderkey")


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) <= 3")
def keep_newest(spark, sf):
    return U.keep_newest(read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).drop("o_orderdate")


@query(f"with {CHANGES}, l as (select * from c qualify row_number() over (partition by path order by ts desc, event_id desc) = 1) select path, ts from l where kind = 'unlink'")
def ghost_registry(spark, sf):
    return C.ghosts(changes(spark, sf))


@query(f"with {CHANGES} select path, kind, ts, event_id from c qualify row_number() over (partition by path order by ts desc, event_id desc) = 1")
def latest_state_per_path(spark, sf):
    return C.latest_state(changes(spark, sf))


@query(f"with {CHANGES} select time_bucket(interval '1 minute', ts) as start, count(*) as n from c group by 1")
def burst_windows(spark, sf):
    return C.bursts(changes(spark, sf), "1 minute")


@query(f"with {CHANGES}, g as (select *, case when ts - lag(ts) over (partition by path order by ts) < interval '30 minutes' then 0 else 1 end as new from c), s as (select *, sum(new) over (partition by path order by ts rows between unbounded preceding and current row) as s from g) select path, min(ts) as start, count(*) as n from s group by path, s")
def session_bursts(spark, sf):
    return C.sessions(changes(spark, sf))


@query(f"with {CHANGES}, l as (select * from c qualify row_number() over (partition by path order by ts desc, event_id desc) = 1), p as (select path, case kind when 'unlink' then 0 when 'add' then 1 else 2 end as priority from l) select path, priority, row_number() over (order by priority, path) as place from p order by place limit 100")
def priority_batches(spark, sf):
    d = C.latest_state(changes(spark, sf)).select("path", C.priority(F.col("kind")).alias("priority"))
    from marram.operators.search import ranked

    d = d.orderBy("priority", "path").limit(100)
    return ranked(d.withColumn("__s", -F.col("priority")), "__s", "path").select("path", "priority", F.col("rank").alias("place"))
