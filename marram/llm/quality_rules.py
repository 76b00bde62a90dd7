"""Learned quality rules (operator 1): text statistics and an ordered list of threshold rules, all in built-in Spark functions.

Sequential covering learns the rules: a rule grows condition by condition to the best information gain over what no earlier
rule covers, is pruned against rows held back from growing, and is kept while those rows bear it out. Every step is one
aggregate over all labelled rows by (feature, threshold bin); the driver sees only these sums, whose number does not depend on
the data. The result is a CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, checked_broadcast

#: Names of the statistics that rules may test, beside the base counts.
FEATURES = ["n_words", "mean_word", "symbols", "dup_lines", "repeats", "capitals", "punctuation", "distinct", "digits", "short_words", "n_lines"]
BLANK = " \\t-\\r"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(h: Column, size: int) -> Column:
    """Words within `size`-word windows whose hashes occur twice or more in the array h of word hashes."""

    def covered(at: Column) -> Column:  # sorted starts of repeated windows: each adds the words up to the next one's
        n = F.size(at)
        added = F.transform(at, lambda p, i: F.when(i + 1 == n, F.lit(size)).otherwise(F.least(F.lit(size), F.get(at, i + 1) - p)))
        return F.aggregate(added, F.lit(0).cast("long"), lambda a, b: a + b)

    def repeated(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.cast("int").alias("p"))))
        like = lambda s, x, k: F.coalesce(x["w"] == F.get(s, k)["w"], F.lit(False))
        return _let(pairs, lambda s: _let(F.sort_array(F.transform(F.filter(s, lambda x, k: like(s, x, k - 1) | like(s, x, k + 1)), lambda x: x["p"])), covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))
    some = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(repeated(w)))
    return F.when(F.size(h) < size + 1, F.lit(0).cast("long")).otherwise(some)


def text_statistics(docs: DataFrame, *, window: int = 5, keep: list[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, the base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: long) and FEATURES (double).

    Words are runs of other than blanks in the whole text; null has none, and all counts are 0 then. Windows are compared by
    64-bit hashes within one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANK}]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    d = docs.select(*keep, text.alias("t"), words.alias("w"), lines.alias("l"))
    n = F.size("w").cast("long")
    part = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    counted = d.select(
        *keep,
        n.alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _let(F.transform("w", lambda x: F.xxhash64(x)), lambda h: F.struct(_repeat_words(h, window).alias("repeat"), F.size(F.array_distinct(h)).alias("distinct"))).alias("h"),
        part(F.size(F.filter("w", lambda x: (x == F.upper(x)) & (x != F.lower(x)) & (F.length(x) > 1)))).alias("capitals"),
        part(F.regexp_count("t", F.lit("[!?]"))).alias("punctuation"),
        part(F.regexp_count("t", F.lit("[0-9]"))).alias("digits"),
        part(F.size(F.filter("w", lambda x: F.octet_length(x) < 3))).alias("short_words"),
        F.size("l").cast("double").alias("n_lines"),
    )
    part = lambda x: F.when(F.col("n_words") > 0, x / F.col("n_words")).otherwise(0.0)
    return counted.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.col("h.repeat").alias("n_repeat_words"),
        part(F.col("word_chars")).alias("mean_word"), part(F.col("n_symbols")).alias("symbols"),
        F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines")).otherwise(0.0).alias("dup_lines"),
        part(F.col("h.repeat")).alias("repeats"), "capitals", "punctuation", part(F.col("h.distinct")).alias("distinct"), "digits", "short_words", "n_lines",
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.col(self.feature).cast("double")
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """True where no rule, taken in order, rejects."""
    out = None
    for r in rules:
        out = F.when(covers(r), F.lit(False)) if out is None else out.when(covers(r), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(True)


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn_rules(spark: SparkSession, stats: DataFrame, labels: DataFrame, ws: Workspace, *, features: list[str] = FEATURES, bins: int = 24, most_rules: int = 8, most_conditions: int = 3, precision: float = 0.95, least_rows: int = 5) -> list[Rule]:
    """Rules that reject (quality 0) from all rows of stats (doc_id, features) with a label (doc_id, quality 0/1).

    Thresholds are `bins` - 1 quantiles of each feature over good and bad rows alike weighted by class, halfway to the next.
    A third of the ids is held back from growing; a rule stays if it rejects at least `precision` bad among what it covers of
    them and of all, and `least_rows` bad rows. Null labels and ids are ignored; conflicting labels of an id count each. No
    bad or no good rows: no rules.
    """
    known = labels.where("quality in (0, 1)").select("doc_id", (F.col("quality") == 0).alias("__bad"))
    rows = stats.select("doc_id", *features).join(known, "doc_id").withColumn("__grow", F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0)
    rows = ws.stage(rows, "labelled")
    at = [k / bins for k in range(1, bins)]
    quantiles = rows.groupBy("__bad").agg(*(F.percentile_approx(F.col(f).cast("double"), at, 10_000).alias(f) for f in features)).collect()  # two rows
    if len(quantiles) < 2:
        return []
    cuts = {f: sorted({float(x) for q in quantiles for x in q[f]}) for f in features}
    bin_of = lambda f: F.aggregate(F.array(*map(F.lit, cuts[f])), F.lit(0), lambda a, t: a + (F.col(f).cast("double") > t).cast("int"))
    binned = rows.select("__bad", "__grow", F.array(*map(bin_of, features)).alias("__bins"))
    # rows alike in every bin are one row with a weight
    binned = ws.stage(binned.groupBy("__bad", "__grow", "__bins").agg(F.count(F.lit(1)).alias("__w")), "binned")

    def held(conditions: list[tuple[int, bool, int]]) -> Column:
        out = F.lit(True)
        for f, above, cut in conditions:
            out = out & ((F.col("__bins")[f] > cut) if above else (F.col("__bins")[f] <= cut))
        return out

    def sums(left: DataFrame, conditions) -> dict[tuple[int, int], list[float]]:
        """By (feature, bin): bad and good rows that grow."""
        by = left.where(held(conditions) & F.col("__grow")).select("__bad", "__w", F.posexplode("__bins").alias("f", "b"))
        out: dict = {}
        for r in by.groupBy("f", "b").agg(F.sum(F.when(F.col("__bad"), F.col("__w")).otherwise(0)).alias("p"), F.sum(F.when(~F.col("__bad"), F.col("__w")).otherwise(0)).alias("n")).collect():
            out[r["f"], r["b"]] = [r["p"], r["n"]]
        return out

    rules: list[list[tuple[int, bool, int]]] = []
    for _ in range(most_rules):
        left = binned.where(~F.when(held(rules[0]), True).otherwise(False)) if rules else binned
        for r in rules[1:]:
            left = left.where(~held(r))
        grown: list[tuple[int, bool, int]] = []
        for _ in range(most_conditions):
            by = sums(left, grown)
            p0, n0 = (sum(v[k] for (f, _), v in by.items() if f == 0) for k in (0, 1))
            if p0 < least_rows or n0 == 0:
                break
            best = (0.0, None)
            for f, name in enumerate(features):
                p = n = 0.0
                for cut in range(len(cuts[name])):
                    x = by.get((f, cut), (0, 0))
                    p, n = p + x[0], n + x[1]
                    for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        if a >= least_rows:
                            best = max(best, (_gain(a, b, p0, n0), (f, above, cut)), key=lambda x: (x[0], str(x[1])))
            if best[1] is None or best[0] <= 1e-9:
                break
            grown.append(best[1])
        if not grown:
            break
        # prune: the shortest beginning of the rule that is as good on the rows held back
        cols = [F.sum(F.when(held(grown[:k]) & (F.col("__grow") == g) & (F.col("__bad") == b), F.col("__w")).otherwise(0)) for k in range(1, len(grown) + 1) for g in (False, True) for b in (True, False)]
        got = [float(x or 0) for x in left.agg(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()]
        worth = [(got[4 * k] - got[4 * k + 1]) / max(got[4 * k] + got[4 * k + 1], 1) for k in range(len(grown))]
        k = max(range(len(grown)), key=lambda i: (worth[i], -i))
        p, n, gp, gn = got[4 * k : 4 * k + 4]
        if p + gp < least_rows or p + gp < precision * (p + n + gp + gn) or p < precision * (p + n):
            break
        rules.append(grown[: k + 1])
    # a threshold lies halfway between a cut and the next one, so a rule leaves values at the edge of what it saw alone
    def real(f: int, above: bool, cut: int) -> Condition:
        c = cuts[features[f]]
        return Condition(features[f], above, (c[cut] + c[cut + 1]) / 2 if above and cut + 1 < len(c) else c[cut])

    return [tuple(real(*c) for c in r) for r in rules]


def base_failed(words: Column, repeats: Column) -> Column:
    """Fewer than 10 words, or over a fifth of them in repeated windows."""
    return (words < 10) | (100 * repeats > 20 * words)


def passing(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that `quality` keeps. The rules are learned from the statistics of labelled rows; then one
    scan of docs tests each row where it lies, so nothing is joined or shuffled but the labelled rows."""
    ws = Workspace(spark, "passing")
    ids = ws.stage(labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct(), "labelled")
    ids = checked_broadcast(ids, 16)
    known = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id"), "left_semi")
    rules = learn_rules(spark, ws.stage(text_statistics(known), "statistics"), labels, ws, **options)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("__doc"), "text")
    rated = text_statistics(rows, keep=["__doc"])
    names = [c for c in rated.columns if c != "__doc"]
    # a generated column, so that the filter isn't pushed below the statistics and evaluated from the text for each condition
    rated = rated.select("__doc", F.inline(F.array(F.struct(*names))))
    return rated.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")) & verdict(rules)).select("__doc.*")


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, ws: Workspace | None = None, **options) -> tuple[DataFrame, list[Rule]]:
    """(doc_id, base counts, features, base_failed, kept) for each row of docs, and the rules learned from labels.

    base_failed: see that function. kept: not base_failed and no rule rejects. Null and empty texts have no words and fail;
    without labels the base alone decides; ids may repeat. An empty table gives no rows and no rules.
    """
    ws = ws or Workspace(spark, "quality")
    stats = ws.stage(text_statistics(docs), "statistics")
    rules = learn_rules(spark, stats, labels, ws, **options)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules)), rules
