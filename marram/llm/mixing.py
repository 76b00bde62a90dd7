"""Mixing sources to target weights (operator 3) by entropy balancing.

Among all rates r_d >= 0 that meet the token constraints, entropy balancing takes those of least token-weighted relative
entropy, sum of size_d * (r_d ln r_d - r_d + 1); they are exp(sum of the multipliers of the groups that the document is in).
Newton's method on the convex dual finds the multipliers from the tokens of each cell (combination of groups), which are all it
reads of the corpus. Rates become whole copies: floor(rate) for each document, and one more for a share of each source, those
first in a hash order of documents. Where that order is cut is found by sums over ever finer ranges of hashes, so the copies of
a document depend on its own row and on one row of its source: nothing is sorted, and texts stay where they lie.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, checked_broadcast

#: Bits of the hash order, and of each range in which its cut is sought.
HASH_BITS, RANGE_BITS, RANGES = 60, 10, 3
#: Most groups of a mix with several constraint columns, whose Hessian the driver solves.
MOST_GROUPS = 2000


def word_count(text: Column) -> Column:
    """Runs of other than blanks; null has none."""
    t = F.regexp_replace(text, "^[ \\t-\\r]+|[ \\t-\\r]+$", "")
    return F.coalesce(F.when(t == "", 0).otherwise(F.size(F.split(t, "[ \\t-\\r]+"))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source, source_size, target from (source, source_size): sources by code point, null last, take the weights in turn and
    share `share` of all sizes; a target stops at `most` times its source's size and what is over goes to the others by weight.

    That is one water level L with target = min(most * size, L * weight), found by running sums over the sources in the order
    in which they fill. The table has one row for each source, so its windows do not grow with the corpus.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    every = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_ = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    t = t.withColumn("level", left / open_)  # of what is left, if this source and all after it are open
    t = t.withColumn("place", F.row_number().over(filling))
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("place", "level"))).over(every)["level"]  # the first that holds
    return t.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def newton(spark: SparkSession, cells: DataFrame, targets: DataFrame, ws: Workspace, *, rounds: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """group, multiplier: the minimum of the dual, sum of tokens * exp(sum of multipliers) over cells less target * multiplier.

    cells (groups: array<int>, one for each constraint column; tokens), targets (group, target). With one constraint column the
    dual falls apart into one for each group, so all rounds are one expression over the groups' tokens, a step of at most 1 each.
    With several, a round is one aggregate over cells for the gradient and the whole Hessian (the mass that two groups share), a
    solve on the driver, and one aggregate for the dual at ever smaller parts of the step, of which the first that lowers it
    enough is taken; those groups are MOST_GROUPS at most. A group without tokens or with target 0 has no multiplier. Targets
    that no rates meet, or too few rounds: an error.
    """
    cells = ws.stage(cells.where("tokens > 0").select(F.monotonically_increasing_id().alias("cell"), F.col("tokens").cast("double").alias("tokens"), F.array_distinct("groups").alias("groups")), "cells")
    columns = cells.agg(F.max(F.size("groups"))).first()[0] or 0
    if columns > 1:
        return _crossing(spark, cells, targets, columns, rounds, tolerance)
    sums = cells.select(F.explode("groups").alias("group"), "tokens").groupBy("group").agg(F.sum("tokens").alias("tokens"))
    t = targets.where("target > 0").join(sums, "group")
    off = lambda x: F.col("target") / (F.col("tokens") * F.exp(x)) - 1
    step = lambda x: F.least(F.greatest(off(x), F.lit(-1.0)), F.lit(1.0))
    x = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(0.0), lambda x, _: F.when(F.abs(off(x)) <= tolerance, x).otherwise(x + step(x)))
    t = ws.stage(t.select("group", "target", "tokens", x.alias("multiplier")), "multipliers")
    if t.where(F.abs(off(F.col("multiplier"))) > 1e-6).limit(1).count():
        raise RuntimeError("the multipliers did not settle")
    return t.select("group", "multiplier")


def _crossing(spark: SparkSession, cells: DataFrame, targets: DataFrame, columns: int, rounds: int, tolerance: float) -> DataFrame:
    goal = {r["group"]: float(r["target"]) for r in targets.where("target > 0").limit(MOST_GROUPS + 1).collect()}
    if len(goal) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups in crossing constraints")
    # a cell with a group whose target is 0 takes nothing
    known = cells.where(F.forall("groups", lambda g: g.isin(list(goal))))
    live = sorted(r[0] for r in known.select(F.explode("groups")).distinct().collect())
    place = {g: i for i, g in enumerate(live)}
    t, x = np.array([goal[g] for g in live]), np.zeros(len(live))

    def mass(y: np.ndarray) -> Column:
        of = F.create_map(*(F.lit(v) for g, z in zip(live, y.tolist(), strict=True) for v in (g, z)))
        return F.col("tokens") * F.exp(F.aggregate("groups", F.lit(0.0), lambda a, g: a + F.element_at(of, g)))

    for _ in range(rounds if live else 0):
        pairs = known.select(F.explode("groups").alias("a"), "groups", mass(x).alias("m")).select("a", F.explode("groups").alias("b"), "m").groupBy("a", "b").agg(F.sum("m").alias("m")).collect()
        hessian = np.zeros((len(live), len(live)))
        for r in pairs:
            hessian[place[r["a"]], place[r["b"]]] = r["m"]
        now = hessian.diagonal()
        gradient = now - t
        if np.abs(gradient / t).max() <= tolerance:
            break
        step = -np.linalg.lstsq(hessian, gradient, rcond=1e-12)[0]  # columns share their total, so it is singular
        parts = [0.5**k for k in range(12)]
        at = known.agg(*(F.sum(mass(x + p * step)).alias(f"m{k}") for k, p in enumerate(parts))).first()
        here, slope = float(now.sum()) / columns - float(t @ x), float(gradient @ step)
        for p, m in zip(parts, at, strict=True):
            if np.isfinite(m) and m - float(t @ (x + p * step)) <= here + 1e-4 * p * slope + 1e-12 * abs(here):
                x = x + p * step
                break
        else:
            break
    if live and np.abs(gradient / t).max() > 1e-6:
        raise RuntimeError("no rates meet the targets, or the multipliers did not settle")
    return spark.createDataFrame([(g, v) for g, v in zip(live, x.tolist(), strict=True)], "group int, multiplier double")


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """docs with __size and __h, its place in the hash order."""
    d = docs.withColumn("__size", word_count(F.col("text")))
    return d.withColumn("__h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "__size"), 64 - HASH_BITS))


def _more(d: DataFrame) -> Column:
    """1 or 0 more copies of a row joined with its source's row of `_plan`; null where it shares its hash with rows of which some only get one."""
    told = F.filter("__told", lambda x: x["h"] == F.col("__h"))
    own = F.when(F.col("__extra") <= 0, 0).when(F.size(told) == 0, (F.col("__h") < F.col("__cut")).cast("int"))
    return own.otherwise(F.when(F.get(told, F.lit(0))["k"] == 0, 0).when(F.get(told, F.lit(0))["k"] == F.get(told, F.lit(0))["m"], 1))


def _plan(spark: SparkSession, docs: DataFrame, ws: Workspace, weights: list[float], share: float, most: int, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """(rows of docs as doc_id, source, __size, __h; the plan; its rows): the plan has, for each source, its size, target and rate,
    __base copies for every document, __cut of the hash order before which documents get one more, and __told: of the m rows of
    hash h, k get one more."""
    d = ws.stage(_keyed(docs, seed).select("doc_id", "source", "__size", "__h"), "sizes")
    targets = source_targets(d.groupBy("source").agg(F.sum("__size").alias("source_size")), weights, share, most)
    targets = ws.stage(targets.withColumn("group", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))), "targets")
    cells = targets.where("source_size > 0").select(F.array("group").alias("groups"), F.col("source_size").alias("tokens"))
    lam = newton(spark, cells, targets.where("source_size > 0").select("group", "target"), ws)
    rate = F.when(F.col("multiplier").isNotNull(), F.least(F.exp("multiplier"), F.lit(float(most)))).otherwise(0.0)
    # within rounding of Newton's last step a rate is a whole number; then no document is left over
    p = targets.join(lam, "group", "left").withColumn("rate", rate)
    p = p.withColumn("rate", F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate")).otherwise(F.col("rate")))
    p = p.withColumn("__base", F.floor("rate")).withColumn("__extra", F.col("target") - F.col("__base") * F.col("source_size"))
    p = ws.stage(p.select(F.col("source").alias("__s"), "source_size", "target", "rate", "__base", "__extra", F.lit(0).cast("long").alias("__range"), F.col("__extra").alias("__room")), "rates")
    n = p.count()

    def with_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
        return rows.join(checked_broadcast(plan, 256, n), rows["source"].eqNullSafe(plan["__s"]))

    live = d.where("__size > 0")
    for k in range(1, RANGES + 2):  # ranges of hashes, at last single hashes
        before, now = HASH_BITS - RANGE_BITS * (k - 1), HASH_BITS - RANGE_BITS * k if k <= RANGES else 0
        mine = with_source(live, p.select("__s", "__range", "__room")).where((F.col("__room") > 0) & (F.shiftright("__h", before) == F.col("__range")))
        sums = mine.groupBy("source", F.shiftright("__h", now).alias("r")).agg(F.sum("__size").alias("tokens"), F.count(F.lit(1)).alias("m"), F.first("__room").alias("room"))
        upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("r"))  # 2**RANGE_BITS rows of a source at most; at last, those of a range of the least size
        cut = sums.withColumn("upto", upto).where("upto > room and upto - tokens <= room")
        cut = ws.stage(cut.select(F.col("source").alias("c"), "r", "m", (F.col("room") - F.col("upto") + F.col("tokens")).alias("left"), "tokens"), "cut")
        p = p.drop("r", "m", "left", "tokens").join(checked_broadcast(cut, 64, n), p["__s"].eqNullSafe(cut["c"]), "left").drop("c")
        if k == 1:
            p = p.withColumn("__all", (F.col("__room") > 0) & F.col("r").isNull())
        if k <= RANGES:
            # a range that is not cut further ends at its own beginning
            p = p.withColumn("__range", F.coalesce("r", F.shiftleft("__range", RANGE_BITS if k > 1 else 0))).withColumn("__room", F.coalesce("left", F.lit(0.0)))
    one = F.struct(F.col("r").alias("h"), F.round(F.col("left") * F.col("m") / F.col("tokens")).cast("long").alias("k"), F.col("m").alias("m"))
    cut = F.when(F.col("r").isNotNull(), F.col("r")).when(F.col("__all"), F.lit(1 << HASH_BITS)).otherwise(F.shiftleft("__range", HASH_BITS - RANGE_BITS * RANGES))
    told = F.when(F.col("r").isNotNull(), F.array(one)).otherwise(F.array().cast("array<struct<h:bigint,k:bigint,m:bigint>>"))
    p = ws.stage(p.select("__s", "source_size", "target", "rate", "__base", "__extra", cut.cast("long").alias("__cut"), told.alias("__told")), "plan")
    for _ in range(2):  # one document of a source more or less, where that is nearer
        p = _nearer(with_source(live, p).where("__extra > 0"), p, ws, n)
    return d, p, n


def _nearer(rows: DataFrame, plan: DataFrame, ws: Workspace, n: int) -> DataFrame:
    """The plan with one document of each source changed between more and no more, where that brings the source nearer its target."""
    told = F.filter("__told", lambda x: x["h"] == F.col("__h"))
    rows = rows.withColumn("told", F.get(told, F.lit(0))).withColumn("more", _more(rows))
    part = F.coalesce(F.col("more").cast("double"), F.col("told.k") / F.col("told.m"))
    gap = rows.groupBy("source").agg((F.first("__extra") - F.sum(part * F.col("__size"))).alias("gap")).select(F.col("source").alias("g"), "gap")
    free = rows.where("told is null")
    after = F.abs(F.col("gap") - F.col("__size") * (1 - 2 * F.col("more")))
    free = free.join(checked_broadcast(gap, 32, n), F.col("source").eqNullSafe(F.col("g"))).where(after < F.abs("gap"))
    best = free.groupBy("source").agg(F.min_by(F.struct("__h", "more"), F.struct(after, F.col("__h"))).alias("b"))
    best = ws.stage(best.select(F.col("source").alias("b_s"), F.col("b.__h").alias("b_h"), F.col("b.more").alias("b_more")), "best")
    # rows that share that hash: all but one stay as they are
    alike = rows.select("source", "__h").join(checked_broadcast(best, 32, n), F.col("source").eqNullSafe(F.col("b_s")) & (F.col("__h") == F.col("b_h")))
    alike = ws.stage(alike.groupBy("b_s", "b_h", "b_more").agg(F.count(F.lit(1)).alias("b_m")), "alike")
    j = plan.join(checked_broadcast(alike, 40, n), plan["__s"].eqNullSafe(alike["b_s"]), "left")
    more = F.array(F.struct(F.col("b_h").alias("h"), (F.when(F.col("b_more") == 1, F.col("b_m") - 1).otherwise(1)).cast("long").alias("k"), F.col("b_m").alias("m")))
    return ws.stage(j.withColumn("__told", F.when(F.col("b_h").isNotNull(), F.concat("__told", more)).otherwise(F.col("__told"))).drop("b_s", "b_h", "b_more", "b_m"), "plan")


def _given(rows: DataFrame, plan: DataFrame, n: int, ws: Workspace, most: int) -> DataFrame:
    """rows (source, __size, __h, ...) with the plan's columns and __copies."""
    j = rows.join(checked_broadcast(plan, 256, n), rows["source"].eqNullSafe(plan["__s"])).drop("__s")
    j = j.withColumn("__more", _more(j))
    if plan.where(F.exists("__told", lambda x: (x["k"] > 0) & (x["k"] < x["m"]))).limit(1).count():
        # of rows that share id and size some get one more: each partition's share of them, then as many of its rows
        part = j.where("__more is null").withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__row", 33))
        x = F.get(F.filter("__told", lambda x: x["h"] == F.col("__h")), F.lit(0))
        per = part.groupBy("source", "__h", "__part").agg(F.count(F.lit(1)).alias("c"), F.first(x).alias("x"))
        upto = F.sum("c").over(Window.partitionBy("source", "__h").orderBy("__part"))
        due = lambda c: F.floor(c * F.col("x.k") / F.col("x.m") + 1e-9)
        per = per.withColumn("upto", upto).select(F.col("source").alias("q_s"), F.col("__h").alias("q_h"), F.col("__part").alias("q_p"), (due(F.col("upto")) - due(F.col("upto") - F.col("c"))).alias("due"))
        per = ws.stage(per, "due")
        part = part.join(checked_broadcast(per, 64), F.col("source").eqNullSafe(F.col("q_s")) & (F.col("__h") == F.col("q_h")) & (F.col("__part") == F.col("q_p")))
        place = F.row_number().over(Window.partitionBy("source", "__h", "__part").orderBy("__row"))
        part = part.withColumn("__more", (place <= F.col("due")).cast("int")).select(*j.columns)
        j = j.where("__more is not null").unionByName(part)
    return j.withColumn("__copies", F.when(F.col("__size") > 0, F.least(F.col("__base") + F.col("__more"), F.lit(most))).otherwise(0).cast("long"))


def mix(spark: SparkSession, docs: DataFrame, *, weights: list[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: int = 2, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken: one row for each row of docs (doc_id, text, source).

    size counts words (null text: 0); null is a source of its own. taken = copies * size with 0 <= copies <= most. Extra copies
    go to documents in hash order until the source's share is met, and single documents then bring it nearer; rows that share
    doc_id and size share their place, and as many of them get one as are due. Reruns agree. A document without words has no
    copies. An empty table gives no rows. Other columns of docs are not read.
    """
    ws = Workspace(spark, "mix")
    d, plan, n = _plan(spark, docs, ws, list(weights), share, most, seed)
    out = _given(d, plan, n, ws, most)
    return out.select("doc_id", "source", F.col("__size").alias("size"), "source_size", "target", "rate", F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).alias("taken"))


def mixed(spark: SparkSession, docs: DataFrame, *, weights: list[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: int = 2, seed: int = 11) -> DataFrame:
    """The rows of docs, all columns, each as often as `mix` copies it, where they lie: texts are neither joined nor dealt, but
    for rows that share doc_id and size with others of which some only get one more."""
    ws = Workspace(spark, "mixed")
    _, plan, n = _plan(spark, docs, ws, list(weights), share, most, seed)
    rows = _keyed(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("__doc"), "doc_id", "text", "source"), seed).drop("doc_id", "text")
    return _given(rows, plan, n, ws, most).select("__doc", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))).select("__doc.*")
