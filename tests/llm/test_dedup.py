"""Near-dedup and repeated passages against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from marram.llm.components import connected_components
from marram.llm.common import Workspace
from marram.llm.near_dedup import deduplicated, near_duplicates
from marram.llm.suffix_dedup import repeated_passages

BLANK = "[^\x20\x09-\x0d]+"


def low(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def made(seed=3):
    """Copies, near copies, short, empty, null and long texts, repeated lines."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeÉß") for _ in range(r.randint(1, 6)))
    base = [[word() for _ in range(n)] for n in (1, 2, 3, 30, 60, 60, 120, 4000)]
    rows, k = [], 0
    for b in base:
        for edits in (0, 0, 1, 1, 2, 4, 8, 16):
            t = list(b)
            for _ in range(edits):
                t[r.randrange(len(t))] = word()
            rows.append((k * 7 % 1009, (" " if edits else "\n").join(t).upper() if edits == 1 else " ".join(t)))
            k += 1
    passage = " ".join(word() for _ in range(55))
    rows += [(2000 + i, " ".join(word() for _ in range(30)) + " " + passage + " " + " ".join(word() for _ in range(20))) for i in range(4)]
    return rows + [(3000, ""), (3001, None), (3002, " \t\n"), (3003, "a " * 300), (3004, "a " * 300)]


def brute_classes(rows, size, percent):
    sets = []
    for _, t in rows:
        w = re.findall(BLANK, low(t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return {d: (len(sets[i]), min(least[find(i)])) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("size,percent,docs,shingles", [(3, 85, 1024, 1_000_000), (5, 80, 1024, 1_000_000), (3, 85, 2, 500)])
def test_near_duplicates(spark, size, percent, docs, shingles):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_duplicates(spark, df, size=size, percent=percent, block_docs=docs, block_shingles=shingles).collect()
    want = brute_classes(rows, size, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(spark, empty).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f")]
    df = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], "doc_id long, text string, component_id string, n long")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(spark, df).collect()]
    assert sorted(got, key=str) == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False)], key=str)
    kept = deduplicated(spark, df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {x["node"]: x["root"] for x in connected_components(spark, spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_repeated_passages(spark):
    rows = made(5)
    got = {r["doc_id"]: r for r in repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    words = {d: re.findall(BLANK, low(t or "")) for d, t in rows}
    count = Counter(tuple(w[k : k + 50]) for w in words.values() for k in range(len(w) - 49))
    seen = set()
    for d in sorted(words):
        w, all_, later = words[d], set(), set()
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            if count[g] > 1:
                all_ |= set(range(k, k + 50))
                if g in seen:
                    later |= set(range(k, k + 50))
                seen.add(g)
        spans = lambda x: {i for s in x for i in range(s["s"], s["e"])}
        assert spans(got[d]["spans"]) == all_ and spans(got[d]["later"]) == later, d
        assert got[d]["n_words"] == len(w) and got[d]["n_repeated"] == len(all_)
    assert repeated_passages(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_that_share_an_id(spark):
    """Each row is linked by its own text; one row of each class stays, and clean texts stay."""
    r = random.Random(7)
    a, b, c = ([f"w{r.randrange(9999)}" for _ in range(80)] for _ in range(3))
    near = lambda t: " ".join([*t[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (1, " ".join(c)), (1, " ".join(c)), (None, " ".join(c)), (None, None)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string").repartition(3)
    got = sorted(((x["doc_id"], x["component_id"], x["kept"]) for x in near_duplicates(spark, df, size=3, percent=85).collect()), key=str)
    assert got == sorted([(1, 1, True)] * 4 + [(2, 1, False), (3, 1, False)] + [(None, None, True)] * 2, key=str)
    left = sorted(((x["doc_id"], x["text"]) for x in deduplicated(spark, df).collect()), key=str)
    assert left == sorted([rows[0], rows[1], rows[4], (None, rows[6][1]), (None, None)], key=str)
    assert deduplicated(spark, df.limit(0)).count() == 0
