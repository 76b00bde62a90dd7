"""Edits, differences and history over text: normalisation levels, fuzzy matches, line diffs, edit plans, versions, logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Levels from strict to loose, and the confidence of a match at each.
LEVELS = {"exact": 1.0, "line-endings": 0.95, "trailing": 0.9, "indentation": 0.87, "whitespace": 0.82, "structural": 0.75}


def normalised(text: Column, level: str, tab: int = 4) -> Column:
    """text at a level: each includes what the ones before it ignore, as far as they can be told apart."""
    if level == "exact":
        return text
    t = F.regexp_replace(text, "\r\n", "\n")
    if level == "line-endings":
        return t
    lines = F.split(t, "\n")
    rtrim = lambda x: F.regexp_replace(x, r"\s+$", "")
    indent = lambda x: F.regexp_replace(F.regexp_extract(x, r"^(\s*)", 1), "\t", " " * tab)
    rest = lambda x: F.regexp_replace(x, r"^\s+", "")
    if level == "trailing":
        return F.array_join(F.transform(lines, rtrim), "\n")
    if level == "indentation":
        return F.array_join(F.transform(lines, lambda x: F.concat(indent(x), rtrim(rest(x)))), "\n")
    if level == "whitespace":
        return F.array_join(F.transform(lines, lambda x: rtrim(F.concat(indent(x), F.regexp_replace(rest(x), r"\s+", " ")))), "\n")
    return F.regexp_replace(F.array_join(F.filter(F.transform(lines, lambda x: F.trim(rtrim(rest(x)))), lambda x: x != ""), "\n"), r"\s+", " ")


def match_level(text: Column, target: Column) -> Column:
    """The strictest level at which text contains target, or null."""
    return F.coalesce(*(F.when(F.contains(normalised(text, lv), normalised(target, lv)), F.lit(lv)) for lv in LEVELS))


def match_confidence(level: Column, before: Column, after: Column, lines: Column) -> Column:
    base = F.element_at(F.create_map(*(F.lit(x) for p in LEVELS.items() for x in p)), level)
    boost = sum((F.when(x, 0.1).otherwise(0.0) for x in (before, after, lines)), F.lit(0.0))
    return F.least(F.lit(1.0), base + boost)


def fuzzy_lines(lines: DataFrame, target: str, *, tolerance: float = 0.3, similar: float = 0.3) -> DataFrame:
    """(id, line, text, distance) of lines within an edit distance of a short target: trigram overlap decides which lines are
    measured, then a bounded distance."""
    from marram.functions import text as T

    most = max(1, int(len(target) * (0.2 if len(target) < 10 else tolerance)))
    near = T.jaccard(F.array_distinct(T.trigrams(F.col("text"))), F.array_distinct(T.trigrams(F.lit(target)))) >= similar
    out = lines.where(near | F.lit(len(target) < 6)).withColumn("distance", F.levenshtein("text", F.lit(target), most))
    return out.where("distance >= 0")


def line_diff(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """The shortest script of ('equal' | 'delete' | 'insert', line), deletions first: the greedy furthest-reaching method.

    far[d][k] is the furthest place in a on diagonal k (place in a less place in b) with d edits."""
    n, m = len(a), len(b)
    far: list[dict[int, int]] = []
    reach = {0: 0}
    d = 0
    while True:
        for k in list(reach):
            x = reach[k]
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
        far.append(reach)
        if reach.get(n - m) == n:
            break
        nxt: dict[int, int] = {}
        for k, x in reach.items():
            if x < n:
                nxt[k + 1] = max(nxt.get(k + 1, -1), x + 1)
            if x - k < m:
                nxt[k - 1] = max(nxt.get(k - 1, -1), x)
        reach = nxt
        d += 1
    out: list[tuple[str, str]] = []
    x, k = n, n - m
    for e in range(d, -1, -1):
        if e == 0:
            out += [("equal", a[i - 1]) for i in range(x, 0, -1)]
            break
        prev = far[e - 1]
        by_delete = prev.get(k - 1, -2) + 1 if prev.get(k - 1, n) < n else -1
        by_insert = prev.get(k + 1, -1) if k + 1 in prev and prev[k + 1] - k - 1 < m else -1
        start, kind = max((by_delete, 1), (by_insert, 0))
        out += [("equal", a[i - 1]) for i in range(x, start, -1)]
        if kind:
            out.append(("delete", a[start - 1]))
            x, k = start - 1, k - 1
        else:
            out.append(("insert", b[start - k - 1]))
            x, k = start, k + 1
    return out[::-1]


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience piles."""
    from bisect import bisect_left

    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        back[i] = at[p - 1] if p else -1
        if p == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[p], at[p] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience_diff(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """Lines unique in both, in a longest common order, anchor the diff; between anchors it goes on, at last by line_diff."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    head, tail = [("equal", x) for x in a[:lo]], [("equal", x) for x in a[len(a) - hi :]]
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    place = {x: i for i, x in enumerate(b)}
    shared = [(i, place[x]) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    anchors = [shared[i] for i in longest_increasing([j for _, j in shared])]
    if not anchors:
        return head + line_diff(a, b) + tail
    out, i, j = [], 0, 0
    for p, q in [*anchors, (len(a), len(b))]:
        out += patience_diff(a[i:p], b[j:q])
        if p < len(a):
            out.append(("equal", a[p]))
        i, j = p + 1, q + 1
    return head + out + tail


def diff_summary(pairs: DataFrame, key: str, old: str, new: str, *, patience: bool = False) -> DataFrame:
    """(key, added, removed, unchanged) lines of each pair of texts, in Arrow batches."""
    diff = patience_diff if patience else line_diff

    def run(batches):
        for pdf in batches:
            rows = []
            for k, x, y in zip(pdf[key], pdf[old], pdf[new]):
                kinds = [kind for kind, _ in diff((x or "").split("\n"), (y or "").split("\n"))]
                rows.append((k, kinds.count("insert"), kinds.count("delete"), kinds.count("equal")))
            yield pd.DataFrame(rows, columns=[key, "added", "removed", "unchanged"])

    return pairs.select(key, old, new).mapInPandas(run, f"{key} {dict(pairs.dtypes)[key]}, added long, removed long, unchanged long")


def overlapping_edits(edits: DataFrame) -> DataFrame:
    """Edits (path, start, end) that begin before the one ahead of them ends."""
    w = Window.partitionBy("path").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return edits.withColumn("__b", before).where(F.col("start") < F.col("__b")).drop("__b")


def semantic_diff(old: DataFrame, new: DataFrame, *, similar: float = 0.8) -> DataFrame:
    """(type, name, new_name, change) of symbols (type, name, body): unchanged ones left out; a removed and an added one of a type
    are a rename where their bodies' tokens are alike enough, each used once, the most alike first."""
    from marram.functions import text as T

    o = old.select("type", "name", F.col("body").alias("ob"))
    n = new.select("type", "name", F.col("body").alias("nb"))
    both = o.join(n, ["type", "name"], "full")
    kept = both.where(F.col("ob").isNotNull() & F.col("nb").isNotNull() & (F.col("ob") != F.col("nb"))).select("type", "name", F.lit(None).cast("string").alias("new_name"), F.lit("modify").alias("change"))
    gone = both.where("nb is null").select("type", "name", F.array_distinct(T.tokens(F.col("ob"))).alias("ot"))
    come = both.where("ob is null").select("type", F.col("name").alias("new_name"), F.array_distinct(T.tokens(F.col("nb"))).alias("nt"))
    pairs = gone.join(come, "type").withColumn("j", T.jaccard(F.col("ot"), F.col("nt"))).where(F.col("j") >= similar)
    best = lambda by, other: F.row_number().over(Window.partitionBy("type", by).orderBy(F.desc("j"), other))
    pairs = pairs.withColumn("__a", best("name", "new_name")).withColumn("__b", best("new_name", "name")).where("__a = 1 and __b = 1")
    moved = pairs.select("type", "name", "new_name", F.lit("rename").alias("change"))
    removed = gone.join(moved, ["type", "name"], "left_anti").select("type", "name", F.lit(None).cast("string").alias("new_name"), F.lit("remove").alias("change"))
    added = come.join(moved, ["type", "new_name"], "left_anti").select("type", F.col("new_name").alias("name"), F.lit(None).cast("string").alias("new_name"), F.lit("add").alias("change"))
    return kept.unionByName(moved).unionByName(removed).unionByName(added)


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("add", "remove", "modify", "rename")))


def fragments(lines: DataFrame, ranges: DataFrame, context: int = 0) -> DataFrame:
    """(path, start, end, text): lines (path, line, text) of ranges (path, start, end), widened by context and merged."""
    from marram.operators.documents import merged_ranges

    r = ranges.select("path", F.greatest(F.col("start") - context, F.lit(1)).alias("start"), (F.col("end") + context).alias("end"))
    r = merged_ranges(r, ["path"], "start", "end")
    d = lines.join(r, "path").where(F.col("line").between(F.col("start"), F.col("end")))
    return d.groupBy("path", "start", "end").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))


def history(log: DataFrame, most: int = 50) -> DataFrame:
    """A log (path, seq, action) of do and undo as the done edits of each path, newest first, at most `most`: an undo takes back
    the last edit that still stands, which a running balance from the end tells."""
    w = Window.partitionBy("path").orderBy(F.desc("seq"))
    d = log.withColumn("__u", F.sum(F.when(F.col("action") == "undo", 1).otherwise(-1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__m", F.coalesce(F.max("__u").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    least = F.coalesce(F.min("__u").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stands = d.withColumn("__l", least).where((F.col("action") == "do") & (F.col("__u") < F.least(F.col("__l"), F.lit(0))))
    return stands.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most).select("path", "seq", "place")


def unambiguous(matches: DataFrame, *, least: float = 0.85, gap: float = 0.15) -> DataFrame:
    """The best match (edit, place, confidence) of each edit, where it is sure and well ahead of the next."""
    w = Window.partitionBy("edit").orderBy(F.desc("confidence"), "place")
    d = matches.withColumn("__n", F.row_number().over(w)).withColumn("__next", F.lead("confidence").over(w)).where("__n = 1")
    return d.where((F.col("confidence") >= least) & (F.col("__next").isNull() | (F.col("confidence") - F.col("__next") >= gap))).drop("__n", "__next")


def escape_variants(target: str) -> list[str]:
    """The target as it is, with its escapes decoded, and with its control characters escaped; without repeats."""
    decoded = target.replace("\\n", "\n").replace("\\t", "\t").replace('\\"', '"')
    encoded = target.replace("\n", "\\n").replace("\t", "\\t")
    return list(dict.fromkeys([target, decoded, encoded]))


def insert_at(text: Column, line: int, added: str) -> Column:
    """text with `added` as line `line` (from 1; one past the last appends)."""
    ls = F.split(text, "\n")
    return F.array_join(F.concat(F.slice(ls, F.lit(1), F.lit(line - 1)), F.array(F.lit(added)), F.slice(ls, F.lit(line), F.greatest(F.size(ls) - line + 1, F.lit(0)))), "\n")


#: Bytes from which deleting a file needs its content's hash.
GUARDED_BYTES = 10_000


def may_delete(size: Column, content_hash: Column, confirmed: Column, force: Column) -> Column:
    """Whether a file may go: small, forced, or confirmed by the hash of its content."""
    return force | (size <= GUARDED_BYTES) | F.coalesce(content_hash == confirmed, F.lit(False))
