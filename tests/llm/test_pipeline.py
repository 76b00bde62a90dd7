"""The whole pipeline on a small corpus, each stage against a plain count of what must stay."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer


def made(spark, folder):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    clean = {i: " ".join(word() for _ in range(60)) for i in range(40)}
    item = " ".join(word() for _ in range(14))
    rows = [(i, t, "s1" if i % 3 else "s2") for i, t in clean.items()]
    rows += [(100, clean[3], "s1"), (101, clean[3], "s2"), (102, clean[4].rsplit(" ", 1)[0], "s1")]  # copies and a near copy
    rows += [(200, clean[5][:100] + " " + item + " " + clean[6][:100], "s1")]  # a benchmark passage
    rows += [(300, "too short", "s1"), (301, "same five words over again " * 20, "s2"), (302, None, "s1"), (303, "", None)]  # fail the base
    spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return clean


def test_pipeline(spark, tmp_path):
    clean = made(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    t = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    sizes = {"s1": 0, "s2": 0}
    for d, x in clean.items():
        sizes["s1" if d % 3 else "s2"] += len(x.split())
    taken = {"s1": 0, "s2": 0}
    start = 0
    for r in got:  # only clean documents, in order, with the library's ids, at most twice each
        ids = np.array([*t.encode(clean[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        taken["s1" if r["doc_id"] % 3 else "s2"] += len(re.findall(r"\S+", clean[r["doc_id"]]))
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)
    assert max(sum(r["doc_id"] == d for r in got) for d in clean) <= 2
    total = 1.5 * sum(sizes.values())  # weights 3 and 1; s1 stops at twice its size or at three quarters
    want = {"s1": min(2 * sizes["s1"], 0.75 * total)}
    want["s2"] = min(2 * sizes["s2"], total - want["s1"])
    assert all(abs(taken[s] - want[s]) <= 30 for s in want), (taken, want)
