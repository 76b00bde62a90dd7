"""The queries of this package's operators: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality

    rated, _ = quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii_crf import personal_data

    return personal_data(spark, table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_passages

    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["s"], x["e"])), ",")
    found = repeated_passages(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_repeated", text("spans").alias("spans"), text("later").alias("later"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"), size=3, percent=85)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import licenses

    return licenses(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secrets

    return secrets(table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_output import token_output

    return token_output(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_pii, op3_mixing, op4_suffix_dedup, op5_minhash_near_dedup, op6_license_scan, op7_warc, op8_decontamination, op9_secrets, op10_token_output, pipeline)}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP5 = rf"""with recursive d as (select doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
u as (select doc_id, len(s) as n, unnest(s) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p where 100 * c >= 85 * (na + nb - c)), e as (select a, b from l union all select b, a from l),
r(doc_id, reach) as (select doc_id, doc_id from s union select r.doc_id, e.b from r join e on e.a = r.reach),
m as (select doc_id, min(reach) as component_id from r group by doc_id)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from s join m using (doc_id)"""

_OP7 = """with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages), f as (select *, min(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type, case when payload_bytes >= 100 and page_id <> first then first end as refers_to from f"""

_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP8 = rf"""with d as (select doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' '))) as g from b where len(w) > 0),
ns as (select distinct n from bw), dw as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) as g from d, ns where len(w) >= n),
h as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as s from (select distinct doc_id, item_id::varchar as s from h) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join hit using (doc_id) left join it using (doc_id)"""


def _op6() -> str:
    from .license_scan import TEMPLATES, THRESHOLD, bounds, template_bigrams

    rows = []
    for place, (name, text) in enumerate(TEMPLATES.items()):
        b = template_bigrams(text)
        low, high = bounds(len(b), THRESHOLD)
        rows.append(f"({place}, '{name}', {b!r}, {low}, {high})")
    return rf"""with t(place, name, b, low, high) as (values {', '.join(rows)}),
x as (select doc_id, coalesce(text, '') as text from documents),
u as (select doc_id, string_split(text, chr(10)) as us from x union all select doc_id, list_filter(string_split_regex(text, '\n[ \t\r]*\n'), lambda p: contains(p, chr(10))) from x where regexp_matches(text, '\n[ \t\r]*\n')),
v as (select doc_id, unnest(us) as u from u), n as (select doc_id, row_number() over () as unit, list_filter(string_split_regex(lower(u), '[^a-z0-9]+'), lambda w: w <> '') as w from v),
g as (select doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) as g from n where len(w) > 1),
m as (select doc_id, unit, place, name, 2.0::double * len(list_intersect(g, b)) / (len(g) + len(b)) as dice from g join t on len(g) between low and high),
k as (select * from m where dice >= {THRESHOLD} qualify row_number() over (partition by unit order by dice desc, place) = 1),
a as (select doc_id, count(*) as n_notices, string_agg(distinct name, ',' order by name) as licenses, arg_max(name, dice * 1000 - place) as best, max(dice) as best_dice from k group by doc_id)
select doc_id, coalesce(n_notices, 0)::bigint as n_notices, coalesce(licenses, '') as licenses, best, best_dice from x left join a using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op5_minhash_near_dedup": _OP5, "op6_license_scan": _op6(), "op7_warc": _OP7, "op8_decontamination": _OP8}
