"""Queries: claims, tags, constraints, conflicts and health, over sentences made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.operators import integrity as I
from marram.plans.registry import query, read

TEXT = """concat(p_brand, case p_partkey % 3 when 0 then ' refund' when 1 then ' delivery' else ' token' end, case p_partkey % 4 when 0 then ' must be within ' when 1 then ' should take at most ' when 2 then ' is <= ' else ' rests ' end, p_size, case p_partkey % 5 when 0 then ' hours.' when 1 then ' minutes.' when 2 then '%.' when 3 then ' days.' else '.' end)"""
LINES = f"s as (select concat('docs/policy_', p_partkey % 50, '.md') as path, p_partkey as line, {TEXT} as text from part)"
CLAIMS = f"""{LINES}, st as (select *, case when regexp_matches(text, '(?i)\\b(must|shall|required|mandatory|not allowed|prohibited)\\b') then 'must' when regexp_matches(text, '(?i)\\b(should|recommended|prefer|ideally)\\b') then 'should'
 when regexp_matches(text, '(?i)\\b\\d+(?:\\.\\d+)?\\s*(ms|s|sec|seconds|m|min|minutes|h|hr|hours|d|days|percent)\\b|\\d+(?:\\.\\d+)?\\s*%') then 'must' end as strength from s),
tg as (select path, text, strength, min(line) as line, list_filter([case when regexp_matches(text, '(?i)\\btoken\\b') then 'security' end, case when regexp_matches(text, '(?i)\\brefund\\b') then 'payment' end], lambda x: x is not null) as tags from st where strength is not null group by path, text, strength)"""


def sentences(spark, sf):
    k = F.col("p_partkey")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (k % n + 1).cast("int"))
    text = F.concat("p_brand", pick(3, " refund", " delivery", " token"), pick(4, " must be within ", " should take at most ", " is <= ", " rests "), "p_size", pick(5, " hours.", " minutes.", "%.", " days.", "."))
    return read(spark, sf, "part").select(F.concat(F.lit("docs/policy_"), k % 50, F.lit(".md")).alias("path"), k.alias("line"), text.alias("text"))


def claims(spark, sf):
    return I.text_claims(sentences(spark, sf))


@query(f"with {CLAIMS} select sha256(concat(path, '::::', text)) as id, path, line, text, strength, array_to_string(tags, ',') as tags from tg")
def claims_text(spark, sf):
    return claims(spark, sf).withColumn("tags", F.array_join("tags", ","))


@query(f"with {CLAIMS} select t as tag, count(*) as n from (select unnest(tags) as t from tg) group by t")
def tags(spark, sf):
    return I.top_domains(claims(spark, sf), 10)


BOUNDED = CLAIMS + """, c as (select *, case when contains(text, ' must be within ') then 1 when contains(text, ' at most ') then 2 when contains(text, ' <= ') then 3 end as form from tg),
v as (select *, regexp_extract(text, '(?:within|at most|<=)\\s*(\\d+)', 1)::double as value, regexp_extract(text, '(?:within|at most|<=)\\s*\\d+\\s*(ms|s|sec|seconds|m|min|minutes|h|hr|hours|d|days|%|percent)?', 1) as unit, regexp_extract(lower(text), '(brand)#(\\d+) (refund|delivery|token)', 2) as b, regexp_extract(text, '(refund|delivery|token)', 1) as noun from c where form is not null),
k as (select *, case when form = 2 then concat(b, ' ', noun, ' should') end as k0 from v),
n as (select path, line, text, strength, tags, case form when 1 then concat(b, ' ', noun, ' must') when 2 then concat(noun, ' should take') else concat('brand ', b, ' ', noun) end as key,
 case when unit in ('h', 'm', 'd', 's', 'ms') then 'time' when unit = '%' then 'percent' else 'unitless' end as unit_type,
 case unit when 'h' then concat((floor(value * 3600 + 0.5))::bigint, 's') when 'm' then concat((floor(value * 60 + 0.5))::bigint, 's') when 'd' then concat((floor(value * 86400 + 0.5))::bigint, 's') when '%' then concat(value::bigint, '%') else concat(value::bigint, '') end as normal from k)"""


@query(f"with {BOUNDED} select path, line, key, unit_type, normal from n")
def constraints_parsed(spark, sf):
    return I.constraints(claims(spark, sf)).select("path", "line", "key", "unit_type", "normal")


CONFLICTS = BOUNDED + """, f as (select key, unit_type, normal, min(struct_pack(path, line, normal, text, strength, tags)) as f from n group by key, unit_type, normal), o as (select key, unit_type, list_sort(list(f))[1:2] as p from f group by key, unit_type having count(*) >= 2),
x as (select key, unit_type, p[1] as a, p[2] as b from o where p[1].path <> p[2].path), y as (select *, len(a.tags) + len(b.tags) > 0 as tagged, a.strength = 'must' or b.strength = 'must' as must, a.strength = 'should' or b.strength = 'should' as should from x),
z as (select key, unit_type, a.path as a_path, b.path as b_path, a.normal as a_normal, b.normal as b_normal, case when tagged then 'high' when must or should then 'warn' else 'info' end as severity, least(0.9, 0.55 + case when must then 0.15 else 0 end + case when should then 0.05 else 0 end)::double as confidence, tagged from y)"""


@query(f"with {CONFLICTS} select key, unit_type, a_path, b_path, a_normal, b_normal, severity, round(confidence, 6) as confidence, round(case severity when 'high' then 1.0 when 'warn' then 0.6 else 0.3 end * confidence + case when tagged then 0.1 else 0 end, 6)::double as priority from z")
def numeric_conflicts(spark, sf):
    return I.conflicts(I.constraints(claims(spark, sf))).select("key", "unit_type", "a_path", "b_path", "a_normal", "b_normal", "severity", F.round("confidence", 6).alias("confidence"), F.round("priority", 6).alias("priority"))


@query(f"with {CONFLICTS} select count(*) as findings, count(*) filter (severity = 'info') as info, count(*) filter (severity = 'warn') as warn, count(*) filter (severity = 'high') as high, round(1 - least(1, coalesce(sum(case severity when 'high' then 0.6 when 'warn' then 0.3 else 0.1 end * confidence), 0) / 5), 6)::double as health from z")
def health_score(spark, sf):
    return I.report(I.conflicts(I.constraints(claims(spark, sf)))).withColumn("health", F.round("health", 6))


@query(f"with {CONFLICTS} select count(*) filter (severity in ('high', 'warn')) > 0 as blocked from z")
def block_policy(spark, sf):
    return I.blocked(I.conflicts(I.constraints(claims(spark, sf))), strict=True)
