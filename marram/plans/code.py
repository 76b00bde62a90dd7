"""Queries: code structure and edits, over source text made from parts and lines made from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.operators import code as C
from marram.operators import documents as D
from marram.operators import edits as E
from marram.operators import graph as G
from marram.plans.registry import query, read

SOURCE = """concat('import { f', (p_partkey + 1) % 200, ' } from ''./p', (p_partkey + 1) % 200, ''';', chr(10), 'export class K', p_partkey, ' {', chr(10), '  run(x) {', chr(10), '    return f', (p_partkey + 1) % 200, '(x, ', p_size, ');', chr(10), '  }', chr(10), '}', chr(10))"""


def sources(spark, sf):
    """One TypeScript file for each part: an import, a class with a method, a call; files p0 to p199 exist to be imported."""
    k = ((F.col("p_partkey") + 1) % 200).cast("string")
    text = F.concat(F.lit("import { f"), k, F.lit(" } from './p"), k, F.lit("';\nexport class K"), "p_partkey", F.lit(" {\n  run(x) {\n    return f"), k, F.lit("(x, "), "p_size", F.lit(");\n  }\n}\n"))
    return read(spark, sf, "part").select(F.concat(F.lit("src/p"), "p_partkey", F.lit(".ts")).alias("path"), text.alias("text"))


@query("select concat('src/p', p_partkey, '.ts') as path, unnest([concat('K', p_partkey), 'run']) as name, unnest(['class', 'method']) as type, unnest([2, 3])::bigint as start_line, unnest([6, 5])::bigint as end_line from part")
def code_symbols(spark, sf):
    return C.symbols(sources(spark, sf)).select("path", "name", "type", "start_line", "end_line")


@query("select concat('src/p', p_partkey, '.ts') as path, 'run' as caller, concat('f', (p_partkey + 1) % 200) as callee, 4::bigint as line, 2::bigint as n_args from part")
def code_calls(spark, sf):
    return C.calls(sources(spark, sf)).select("path", "caller", "callee", "line", "n_args")


@query("with f as (select p_partkey as k from part) select concat('src/p', p_partkey, '.ts') as src, concat('src/p', (p_partkey + 1) % 200, '.ts') as dst from part where (p_partkey + 1) % 200 in (select k from f)")
def dependency_edges(spark, sf):
    from marram.storage import cut

    s = sources(spark, sf)
    i = cut(C.imports(s), "imports").select("path", "specifier").distinct()
    return G.resolve_imports(i, s.select("path")).where("resolved is not null").select(F.col("path").alias("src"), F.col("resolved").alias("dst"))


@query(r"with d as (select doc_id, string_split(text, chr(10)) as l from documents), n as (select doc_id, len(l) as n, len(list_filter(range(1, len(l) + 1), lambda i: i % 3 = 0)) as gone from d) select doc_id, 0::bigint as added, gone::bigint as removed, (n - gone)::bigint as unchanged from n")
def line_diff(spark, sf):
    """Each document against itself without every third line: the shortest script removes just those."""
    ls = F.split("text", "\n")
    d = read(spark, sf, "documents").select("doc_id", F.col("text").alias("old"), F.array_join(F.filter(ls, lambda x, i: (i + 1) % 3 != 0), "\n").alias("new"))
    one = F.size(F.split("old", "\n"))
    return E.diff_summary(d.where(one > 0), "doc_id", "old", "new").select("doc_id", "added", "removed", "unchanged")


@query(r"""select doc_id, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+$', '')), chr(10))) as trailing, sha256(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)), '\s+', ' ', 'g')) as structural from documents""")
def normalisation_levels(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", *(F.sha2(E.normalised(F.col("text"), lv), 256).alias(lv) for lv in ("trailing", "structural")))


@query("with e as (select o_custkey as path, o_orderkey % 1000 as a, o_orderkey % 1000 + 5 as b from orders), m as (select *, max(b) over (partition by path order by a, b rows between unbounded preceding and 1 preceding) as mb from e) select path, a as start, b as \"end\" from m where a < mb")
def overlapping_edits(spark, sf):
    k = F.col("o_orderkey") % 1000
    return E.overlapping_edits(read(spark, sf, "orders").select(F.col("o_custkey").alias("path"), k.alias("start"), (k + 5).alias("end")))


@query(r"with l as (select doc_id, string_split_regex(text, '\r?\n') as l from documents), u as (select doc_id, unnest(range(1, len(l) + 1)) as line, unnest(l) as text from l) select doc_id as path, 1::bigint as start, 3::bigint as \"end\", string_agg(text, chr(10) order by line) as text from u where line <= 3 group by doc_id".replace('\\"', '"'))
def read_fragment(spark, sf):
    n = D.lines(read(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text"), "path")
    r = n.select("path").distinct().select("path", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("start"), F.lit(2).cast("long").alias("end")), F.struct(F.lit(3).cast("long").alias("start"), F.lit(3).cast("long").alias("end")))).alias("r")).select("path", "r.start", "r.end")
    return E.fragments(n, r)


@query("with a as (select concat('t', p_partkey % 7) as type, concat('s', p_partkey) as name, p_type as body from part), b as (select type, name, case when name like '%5' then concat(body, ' x') else body end as body from a where name not like '%9') select a.type, a.name, null::varchar as new_name, case when b.body is null then 'remove' else 'modify' end as change from a left join b using (type, name) where b.body is null or a.body <> b.body")
def semantic_diff(spark, sf):
    k = F.col("p_partkey")
    a = read(spark, sf, "part").select(F.concat(F.lit("t"), k % 7).alias("type"), F.concat(F.lit("s"), k).alias("name"), F.col("p_type").alias("body"))
    b = a.where(~F.col("name").endswith("9")).withColumn("body", F.when(F.col("name").endswith("5"), F.concat("body", F.lit(" x"))).otherwise(F.col("body")))
    return E.semantic_diff(a, b)
