"""Relationship graphs as edge tables (src, dst): degrees, traversals, PageRank, cycles, hot spots, impact.

Iterations write their frontier or ranks through a reliable checkpoint, so lineage stays short and a lost executor costs little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marram.storage import cut


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out), one shuffle for both."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def neighbors(edges: DataFrame, node: int, direction: str = "both") -> DataFrame:
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("node"), F.lit("downstream").alias("direction"))
    back = edges.where(F.col("dst") == node).select(F.col("src").alias("node"), F.lit("upstream").alias("direction"))
    return {"downstream": out, "upstream": back}.get(direction, out.unionByName(back)).distinct()


def bfs(spark: SparkSession, edges: DataFrame, start: DataFrame, *, depth: int = 20, direction: str = "downstream") -> DataFrame:
    """(node, depth) reachable from start (node), start left out: a join and an anti join for each level, until none is new."""
    step = {"downstream": edges.select("src", "dst"), "upstream": edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))}
    step = step[direction] if direction in step else step["downstream"].unionByName(step["upstream"])
    seen = cut(start.select("node", F.lit(0).cast("long").alias("depth")).distinct())
    frontier = seen
    for level in range(1, depth + 1):
        new = step.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        new = cut(new.join(seen, "node", "left_anti").withColumn("depth", F.lit(level).cast("long")))
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new
    return seen.where("depth > 0")


def reverse_index(edges: DataFrame) -> DataFrame:
    """(dst, importers): how many distinct sources point at a node."""
    return edges.distinct().groupBy("dst").agg(F.count(F.lit(1)).alias("importers"))


def pagerank(spark: SparkSession, edges: DataFrame, *, rounds: int = 20, damping: float = 0.85, every: int = 6) -> DataFrame:
    """(node, rank): duplicate edges count; ranks of nodes without an edge out are spread over all."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    links = cut(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")).join(out, "src").select("src", "dst", (F.col("m") / F.col("n")).alias("w")))
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    nodes = cut(nodes.join(out.select(F.col("src").alias("node"), F.lit(True).alias("leads")), "node", "left"))
    total = nodes.count()
    ranks = nodes.select("node", "leads", F.lit(1.0 / total).alias("rank"))
    for k in range(rounds):
        given = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("rank")).alias("got"))
        loose = ranks.where("leads is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        ranks = nodes.join(given, "node", "left").crossJoin(F.broadcast(loose))  # one row
        ranks = ranks.select("node", "leads", ((1 - damping) / total + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / total)).alias("rank"))
        if (k + 1) % every == 0 and k + 1 < rounds:
            ranks = cut(ranks)
    return ranks.select("node", "rank")


def _peeled(live: DataFrame) -> DataFrame:
    """The edges (src, dst) left when nodes without an edge in or without one out are taken away until there are none."""
    n = live.count()
    while n:
        ends = live.select(F.col("src").alias("node")).intersect(live.select(F.col("dst").alias("node")))
        live = cut(live.join(ends.select(F.col("node").alias("src")), "src", "left_semi").join(ends.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
        m = live.count()
        if m == n:
            break
        n = m
    return live


def _least(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(node, own, label): the least `own` of the nodes that reach a node, itself included; rounds until no label changes."""
    labels = cut(own.select("node", "own", F.col("own").alias("label")))
    while True:
        given = edges.join(labels.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("given"))
        new = cut(labels.join(given, "node", "left").select("node", "own", F.least("label", "given").alias("label"), (F.col("given") < F.col("label")).alias("moved")))
        labels = new.select("node", "own", "label")
        if new.where("moved").isEmpty():
            return labels


def cyclic_nodes(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node) on cycles, loops included: after peeling, edges between nodes of unlike least ancestor or unlike least descendant are
    on no cycle and go, and so on until none goes; then each edge left lies within a strongly connected component."""
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    live = _peeled(cut(edges.select("src", "dst").where("src <> dst").distinct()))
    while n := live.count():
        own = cut(live.select(F.col("src").alias("node")).distinct().withColumn("own", F.col("node")))
        up = _least(live, own).select("node", F.col("label").alias("up"))
        down = _least(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")), own).select("node", F.col("label").alias("down"))
        both = cut(up.join(down, "node"))
        a = both.select(F.col("node").alias("src"), F.struct("up", "down").alias("a"))
        b = both.select(F.col("node").alias("dst"), F.struct("up", "down").alias("b"))
        kept = _peeled(cut(live.join(a, "src").join(b, "dst").where("a = b").select("src", "dst")))
        if kept.count() == n:
            break
        live = kept
    return live.select(F.col("src").alias("node")).unionByName(loops).distinct()


def hot_spot_score(n_in: Column, name: Column, index_export: Column, kind: Column) -> Column:
    """In-degree from 5 on (half of it, at most 10), telling names 3, exports of an index file 5, classes and interfaces 2."""
    named = name.rlike("(?i)^(get|set|create|update|delete|handle|process)") | name.rlike("Service$|Controller$|^use[A-Z]")
    return F.when(n_in >= 5, F.least(n_in / 2, F.lit(10.0))).otherwise(0.0) + F.when(named, 3.0).otherwise(0.0) + F.when(index_export, 5.0).otherwise(0.0) + F.when(kind.isin("class", "interface"), 2.0).otherwise(0.0)


def risk_score(files: Column, symbols: Column, rank: Column, breaking: Column, entry: Column) -> Column:
    total = F.least(files * 3, F.lit(30)) + F.least(symbols * 5, F.lit(20)) + rank * 30 + F.least(breaking * 10, F.lit(20)) + F.when(entry, 10).otherwise(0)
    return F.least(total, F.lit(100.0))


def risk_level(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 35, "medium").otherwise("low")


def role(rank: Column, n_in: Column | None = None, n_out: Column | None = None) -> Column:
    """By rank alone, or by rank and degrees."""
    if n_in is None:
        return F.when(rank >= 0.15, "core").when(rank >= 0.08, "integration").when(rank >= 0.04, "utility").otherwise("peripheral")
    return F.when((rank >= 0.15) | (n_in + n_out >= 15), "core").when((n_in >= 5) & (n_out >= 5), "integration").when(n_out > n_in, "utility").otherwise("peripheral")


def overlapping(left: DataFrame, right: DataFrame, by: str, *, span: int = 64, rows: int = 4096, packed: int = 256) -> DataFrame:
    """Pairs of rows (by, a, b) and (by, c, d) with a <= d and b >= c: an equi-join on the buckets that both ranges touch, each
    pair taken in the first bucket they share.

    Rows of the right with equal ranges are packed, `packed` at most, and meet a left row at once; a bucket's left rows are dealt to
    shares of about `rows`, each with the packs of the bucket, so that no task gets a whole hot key. The pairs themselves are as many
    as they are: nothing but them grows with the square of a key."""
    bucket = lambda v: F.floor(F.col(v) / span)
    buckets = lambda s, e: F.explode(F.sequence(bucket(s), bucket(e)))
    most = lambda d, *keys: d.groupBy(by, *keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    # written, so that a row's number stays the same if a task runs again
    x, y = cut(left.withColumn("__k", buckets("a", "b")), "overlapping"), cut(right, "overlapping")
    shares, packs = -(-most(x, "__k") // rows), -(-most(y, "c", "d") // packed)
    number = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n))
    rest = [c for c in right.columns if c not in (by, "c", "d")]
    y = y.withColumn("__p", number(packs)).groupBy(by, "c", "d", "__p").agg(F.collect_list(F.struct(F.lit(0).alias("__0"), *rest)).alias("__y")).drop("__p")
    y = y.withColumn("__k", buckets("c", "d")).withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    x = x.withColumn("__s", number(shares))
    first = F.greatest(bucket("a"), bucket("c"))
    met = x.hint("merge").join(y, [by, "__k", "__s"]).where((F.col("a") <= F.col("d")) & (F.col("b") >= F.col("c")) & (F.col("__k") == first))
    names = [by, *(c for c in left.columns if c != by), *(c for c in right.columns if c != by)]
    return met.withColumn("__y", F.explode("__y")).select(*(F.col(f"__y.{c}").alias(c) if c in rest else F.col(c) for c in names))


def index_status(edges: DataFrame, unresolved: DataFrame, *, stale_hours: float | None = None) -> DataFrame:
    """One row: resolved and unresolved edges, their ratio, and confidence high (none unresolved), medium (under a quarter) or low,
    a step lower where the index is over an hour old."""
    d = edges.agg(F.count(F.lit(1)).alias("resolved")).crossJoin(unresolved.agg(F.count(F.lit(1)).alias("unresolved")))
    ratio = F.when(F.col("resolved") + F.col("unresolved") > 0, F.col("unresolved") / (F.col("resolved") + F.col("unresolved"))).otherwise(0.0)
    level = F.when(ratio == 0, 2).when(ratio < 0.25, 1).otherwise(0) - (1 if stale_hours and stale_hours > 1 else 0)
    return d.select("resolved", "unresolved", ratio.alias("ratio"), F.element_at(F.array(F.lit("low"), F.lit("low"), F.lit("medium"), F.lit("high")), level + 2).alias("confidence"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, specifier, resolved) of relative imports (path, specifier): candidates in order (the file, six extensions, index files),
    met with the files (path) by one equi-join; the first that exists counts."""
    from marram.operators.documents import resolve_link

    endings = ["", ".ts", ".tsx", ".js", ".jsx", ".json", ".py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    base = resolve_link(F.col("path"), F.col("specifier"))
    d = imports.where(F.col("specifier").rlike(r"^\.\.?/|^/")).select("path", "specifier", F.posexplode(F.transform(F.array(*map(F.lit, endings)), lambda e: F.concat(base, e))).alias("place", "candidate"))
    hit = d.join(files.select(F.col("path").alias("candidate")), "candidate")
    best = hit.groupBy("path", "specifier").agg(F.min_by("candidate", "place").alias("resolved"))
    return imports.join(best, ["path", "specifier"], "left")


def resolve_calls(calls: DataFrame, definitions: DataFrame, bindings: DataFrame) -> DataFrame:
    """(caller, callee, dst, tier): calls (caller, path, callee) meet definitions (path, name, id) of their own file or of what they
    import (path, local, source, name); only where neither has one, any definition of that name."""
    own = calls.join(definitions, (calls["path"] == definitions["path"]) & (calls["callee"] == definitions["name"])).select(calls["caller"], calls["callee"], F.col("id").alias("dst"), F.lit(1).alias("tier"))
    b = bindings.select(F.col("path").alias("bp"), "local", "source", F.col("name").alias("bn"))
    via = calls.join(b, (calls["path"] == b["bp"]) & (calls["callee"] == b["local"])).join(definitions, (F.col("source") == definitions["path"]) & (F.col("bn") == definitions["name"])).select(calls["caller"], calls["callee"], F.col("id").alias("dst"), F.lit(1).alias("tier"))
    near = own.unionByName(via).distinct()
    left = calls.join(near.select("caller", "callee").distinct(), ["caller", "callee"], "left_anti")
    far = left.join(definitions, left["callee"] == definitions["name"]).select("caller", "callee", F.col("id").alias("dst"), F.lit(2).alias("tier"))
    return near.unionByName(far).distinct()


def ghost_methods(calls: DataFrame) -> DataFrame:
    """(name, method, n_calls, n_files, arity, awaited): what calls say of a missing interface (name, method, path, args, awaited)."""
    per = calls.groupBy("name", "method", "args").agg(F.count(F.lit(1)).alias("k"))
    arity = per.groupBy("name", "method").agg(F.max_by("args", F.struct("k", -F.col("args"))).alias("arity"), F.max("k").alias("usual"))
    all_ = calls.groupBy("name", "method").agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct("path").alias("n_files"), F.avg(F.col("awaited").cast("int")).alias("awaited"))
    d = all_.join(arity, ["name", "method"])
    consistent = F.col("usual") / F.col("n_calls")
    level = F.when((F.col("n_calls") >= 8) & (F.col("n_files") >= 2) & (consistent > 0.8), "high").when((F.col("n_calls") >= 3) | ((F.col("n_files") >= 2) & (consistent > 0.5)), "medium").otherwise("low")
    return d.select("name", "method", "n_calls", "n_files", "arity", "awaited", level.alias("confidence"))


def clusters(symbols: DataFrame, edges: DataFrame, seeds: DataFrame, *, colocated: int = 10, linked: int = 15) -> DataFrame:
    """(seed, relation, symbol, place): for seeds (seed), symbols (symbol, path) of the same file, and callers and callees by edges
    (src, dst), each relation cut to its limit in name order. A file hands on its first symbols only, one more than the limit (the
    seed itself may be among them), so the work grows with symbols and edges, not with the square of a file."""
    s = seeds.distinct().join(symbols.select(F.col("symbol").alias("seed"), "path"), "seed").distinct()
    head = _first_of(symbols.select("path", "symbol").distinct(), ["path"], "symbol", colocated + 1)
    same = s.join(head, "path").where("symbol <> seed").select("seed", "symbol").distinct()
    callers = seeds.join(edges, seeds["seed"] == edges["dst"]).select("seed", F.col("src").alias("symbol")).distinct()
    callees = seeds.join(edges, seeds["seed"] == edges["src"]).select("seed", F.col("dst").alias("symbol")).distinct()
    out = None
    for d, relation, most in ((same, "colocated", colocated), (callers, "caller", linked), (callees, "callee", linked)):
        d = _first_of(d, ["seed"], "symbol", most)
        d = d.select("seed", F.lit(relation).alias("relation"), "symbol", F.row_number().over(Window.partitionBy("seed").orderBy("symbol")).cast("long").alias("place"))
        out = d if out is None else out.unionByName(d)
    return out


def _first_of(rows: DataFrame, by: list[str], order: str, most: int, parts: int = 64) -> DataFrame:
    """The first `most` rows of each key in an order: those of `parts` shares of a key first, so that no task gets a whole large key."""
    part = F.pmod(F.xxhash64(order), F.lit(parts))
    for keys in ([*by, "__part"], by):
        w = Window.partitionBy(*keys).orderBy(order)
        rows = rows.withColumn("__part", part).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n", "__part")
    return rows


def rank_delta(spark: SparkSession, scoped: DataFrame, whole: DataFrame, *, rounds: int = 12) -> DataFrame:
    """(node, delta): each node's rank in the scoped graph less that in the whole one, to six decimals; 0 where it isn't in one."""
    a, b = (cut(pagerank(spark, e, rounds=rounds, every=2)).withColumnRenamed("rank", c) for e, c in ((scoped, "__a"), (whole, "__b")))
    return a.join(b, "node", "full").select("node", F.round(F.coalesce("__a", F.lit(0.0)) - F.coalesce("__b", F.lit(0.0)), 6).alias("delta"))


def mermaid(nodes: DataFrame, edges: DataFrame, *, most_nodes: int = 12, most_edges: int = 30) -> str:
    """A flow chart of the nodes of highest rank and the edges between them."""
    names = [r["node"] for r in nodes.orderBy(F.desc("rank"), "node").limit(most_nodes).collect()]
    at = {n: f"n{i}" for i, n in enumerate(names)}
    inside = edges.where(F.col("src").isin(names) & F.col("dst").isin(names)).select("src", "dst").distinct().orderBy("src", "dst").limit(most_edges)
    lines = [f'  {at[n]}["{n}"]' for n in names] + [f"  {at[r['src']]} --> {at[r['dst']]}" for r in inside.collect()]
    return "\n".join(["graph TD", *lines])


def insights(ranks: DataFrame, *, hot: int, most: float = 0.8, nodes: int = 20, spots: int = 5) -> DataFrame:
    """(kind, severity, node, confidence) over ranks (node, rank): nodes that nearly all rank gathers in, a graph of over `nodes`
    nodes, and over `spots` hot spots."""
    god = ranks.where(F.col("rank") > most).select(F.lit("architecture").alias("kind"), F.lit("high").alias("severity"), F.col("node").cast("string").alias("node"), F.lit(0.9).alias("confidence"))
    wide = ranks.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > nodes).select(F.lit("risk").alias("kind"), F.lit("medium").alias("severity"), F.lit(None).cast("string").alias("node"), F.lit(0.8).alias("confidence"))
    out = god.unionByName(wide)
    return out.unionByName(ranks.agg(F.count(F.lit(1))).select(F.lit("maintenance").alias("kind"), F.lit("medium").alias("severity"), F.lit(None).cast("string").alias("node"), F.lit(0.85).alias("confidence"))) if hot > spots else out


def call_signals(spark: SparkSession, edges: DataFrame, entries: DataFrame, *, depth: int = 20) -> DataFrame:
    """(node, depth, n_in, n_out, entry): distance from the nearest entry (node) and degrees of all nodes reached."""
    near = bfs(spark, edges, entries, depth=depth).unionByName(entries.select("node", F.lit(0).cast("long").alias("depth")))
    near = near.groupBy("node").agg(F.min("depth").alias("depth"))
    return near.join(degrees(edges), "node", "left").select("node", "depth", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"), (F.col("depth") == 0).alias("entry"))


def with_files(edges: DataFrame, files: DataFrame, end: str = "src") -> DataFrame:
    """Edges with the columns of files (named as the edges' `end`) that their end lies in; others are left out."""
    return edges.join(files, end)


def unresolved(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges whose target (dst) is no known one."""
    return edges.join(known.select("dst").distinct(), "dst", "left_anti").select("src", "dst")


def symbols_of_files(symbols: DataFrame) -> DataFrame:
    """(path, kind, n, first): the symbols (path, kind, name) of each file by kind, and the first name."""
    return symbols.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))
