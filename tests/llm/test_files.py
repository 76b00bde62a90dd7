"""Token files, WARC archives and mixing: round trips and sums."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from marram.llm import token_output as T
from marram.llm import warc
from marram.llm.common import Workspace
from marram.llm.mixing import mix, mixed, newton

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50_000) | st.just(0) | st.just(1), max_size=400))
def test_simple8b(values):
    v = np.array(values, np.uint64)
    words, upto, escapes = T.pack(v)
    assert upto.tolist() == [0, len(words)]
    head, entries, ids = T.decoded(T.block([(7, len(v), words, escapes, True)], 5))
    assert (ids == v).all() and int(head["start"]) == 5 and entries.tolist() == [(7, len(v), len(words), 1, 0)]
    # two documents in one run have words of their own; cut ones come back whole
    k = len(v) // 3
    words, upto, escapes = T.pack(v, np.array([0, k, len(v)]))
    mine = escapes[escapes["at"] >= k].copy()
    mine["at"] -= k
    pieces = list(T._cut(8, len(v) - k, words[upto[1] :], mine, 50))
    assert all(p[1] <= 60 for p in pieces) and [p[4] for p in pieces] == [False] * (len(pieces) - 1) + [True]
    back = [T.decoded(T.block([p], 0))[2] for p in pieces]
    assert (np.concatenate(back) == v[k:]).all()


def test_no_block_holds_the_separator():
    words = np.frombuffer(T.END * 3, "<u8")
    n = int(T.counts_of(words).sum())
    raw = T.block([(1, n, words, np.zeros(0, T._ESCAPE), True)], 0)
    assert T.END not in raw and (T.decoded(raw)[2] == T.unpack(words)).all()


def test_an_id_of_many_rows_goes_to_several_ranges():
    bounds = np.array([3, 7, 7, 7, 9])
    assert T.parts(np.array([1, 3, 4, 8, 9, 10]), bounds, 5).tolist() == [0, 0, 1, 4, 4, 5]
    assert T.parts(np.full(8, 7), bounds, 2).tolist() == [3, 4, 1, 2, 3, 4, 1, 2]


def test_crc32_of_both():
    r = random.Random(1)
    for _ in range(50):
        a, b = r.randbytes(r.randrange(300)), r.randbytes(4 * r.randrange(300))
        assert T.crc32_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


ALPHABET = "aAzZéÀßñÿÖ×÷ØΩω'.,!<|>$#-_*09 \t\n\u00a0\u0301\u0130İǰJ\u030cſﬁ中あ🙂\u200bÆœ"


def test_encoder_equals_the_library():
    """Words, pieces and remembered words give the ids of whole texts, with and without room to remember."""
    from tokenizers import Tokenizer

    r, t = random.Random(3), Tokenizer.from_file(PATH)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(40))) for _ in range(6000)]
    texts += ["<|endoftext|>", "a<|startoftext|>b", "x" * 1000, "'s't're don't we'll", "A\u0301 J\u030c", "\x1ca\x1fb"]
    raw = [x.encode() for x in texts]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for cache in (2000, 40 << 20):
        e = T.Encoder(PATH, cache)
        assert e.pieces
        for a in range(0, len(raw), 500):
            part = raw[a : a + 500]
            ids, lo = e.encode(np.frombuffer(b"".join(part), np.uint8), np.r_[0, np.cumsum([len(x) for x in part])])
            for k in range(len(part)):
                assert ids[lo[k] : lo[k + 1]].tolist() == want[a + k], texts[a + k]
        assert e.young.size() <= cache + (4 << 20)


def test_token_output(spark):
    rows = [(5, "The cat, sat!  on\nthe MAT's <|endoftext|> 12ab éÀ ßñ Ωmega's"), (1, None), (3, ""), (9, "x " * 4000), (4, "don't it's we hi"), (2, "***&&& $$$ a,b.c")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int").repartition(3)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in T.token_output(spark, df, PATH, block_ids=1000).collect()}
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(PATH), 0
    for d, text in sorted(rows):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[d] == (start, len(ids), zlib.crc32(ids.tobytes())), d
        start += len(ids)
    assert T.token_output(spark, df.limit(0), PATH).count() == 0
    twice = T.token_output(spark, spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string"), PATH).orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in twice] == [(None, 2), (1, 2), (1, 2)]
    many = spark.createDataFrame([(k // 7, "w " * (k % 50)) for k in range(700)] + [(50, "word x " * 30_000)], "doc_id long, text string")
    rows = T.token_output(spark, many.repartition(3), PATH, least_bytes=5000).orderBy("start", "n_tokens").collect()
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows) and len(rows) == 701
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:])) and max(r["n_tokens"] for r in rows) > 50_000


def test_warc(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    long = "é" * 60
    rows = [(3, "u", long), (1, "u\r\nX: y", long), (2, None, long + "x"), (4, "u", fake * 3 + "tail" * 40), (5, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (9, "u", fake * 3 + "tail" * 40)]
    pages = spark.createDataFrame([(p, u, h, "z") for p, u, h in rows], "page_id long, url string, html string, digest string")
    got = {r["page_id"]: r for r in warc.warc_round_trip(spark, pages).collect()}
    assert len(got) == len(rows)
    for p, _, h in rows:
        raw = (h or "").encode()
        assert (got[p]["payload_bytes"], got[p]["payload_digest"], got[p]["broken"]) == (len(raw), hashlib.sha256(raw).hexdigest(), False)
        first = min(q for q, _, x in rows if x == h)
        later = len(raw) >= 100 and first != p
        assert (got[p]["record_type"], got[p]["refers_to"]) == (("revisit", first) if later else ("response", None)), p
        assert got[p]["payload"] == (None if later else raw)
    assert warc.warc_round_trip(spark, pages.limit(0)).count() == 0


def test_pointer_jumping():
    record = lambda body: warc.MAGIC + f"Content-Length: {len(body)}\r\n\r\n".encode() + body + warc.GAP
    r = random.Random(4)
    parts, starts, at = [], [], 0
    for _ in range(200):
        body = b"".join(record(b"in" * r.randrange(5)) for _ in range(r.randrange(3)))
        starts.append(at)
        parts.append(record(body))
        at += len(parts[-1])
    pos, nxt, _ = warc.candidates(b"".join(parts))
    assert pos[warc.reachable(pos, nxt)].tolist() == starts and len(pos) > len(starts)


def level(caps, weights, total):
    open_ = set(range(len(caps)))
    t = [0.0] * len(caps)
    while open_:
        left = total - sum(caps[i] for i in range(len(caps)) if i not in open_)
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > caps[i]}
        if not over:
            for i in open_:
                t[i] = unit * weights[i]
            break
        for i in over:
            t[i] = caps[i]
        open_ -= over
    return t


def test_mix(spark):
    r = random.Random(8)
    rows = [(i, r.choice(["b", "a", "é", None, "big", "big", "big"]), " ".join("w" * r.randint(0, 120))) for i in range(600)] + [(9000, "empty", ""), (9001, None, None), (7, "a", "x y"), (7, "a", "x y")]
    df = spark.createDataFrame([(d, s, t, 3.0) for d, s, t in rows], "doc_id long, source string, text string, target double").repartition(3)
    got = mix(spark, df).collect()
    assert len(got) == len(rows)
    names = sorted({s for _, s, _ in rows if s is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(len((t or "").split()) for _, x, t in rows if x == s) for s in names]
    want = dict(zip(names, level([2 * x for x in sizes], [[3, 1, 2][i % 3] for i in range(len(names))], 1.5 * sum(sizes))))
    for s, z in zip(names, sizes):
        mine = [x for x in got if x["source"] == s]
        assert all(x["source_size"] == z and abs(x["target"] - want[s]) < 1e-6 * max(1, want[s]) and x["taken"] <= 2 * x["size"] for x in mine)
        assert abs(sum(x["taken"] for x in mine) - want[s]) <= 5, s
    again = mix(spark, df).collect()
    assert sorted((x["doc_id"], x["size"], x["taken"]) for x in got) == sorted((x["doc_id"], x["size"], x["taken"]) for x in again)
    out = mixed(spark, df)
    assert out.columns == df.columns and sum(len((x["text"] or "").split()) for x in out.collect()) == sum(x["taken"] for x in got)
    assert mix(spark, df.limit(0)).count() == 0 and mixed(spark, df.limit(0)).count() == 0


def test_newton_with_crossing_constraints(spark):
    """Two constraint columns: the rates meet all four targets; the same by numpy."""
    tokens = {(1, 3): 500.0, (1, 4): 100.0, (2, 3): 300.0, (2, 4): 100.0}
    targets = {1: 300.0, 2: 700.0, 3: 800.0, 4: 200.0}
    cells = spark.createDataFrame([(list(g), t) for g, t in tokens.items()], "groups array<int>, tokens double")
    lam = {r["group"]: r["multiplier"] for r in newton(spark, cells, spark.createDataFrame(list(targets.items()), "group int, target double"), Workspace(spark, "t")).collect()}
    rate = {g: np.exp(sum(lam[x] for x in g)) for g in tokens}
    for x, want in targets.items():
        assert abs(sum(t * rate[g] for g, t in tokens.items() if x in g) - want) < 1e-6
    m = np.array([[500.0, 100], [300, 100]])  # iterative proportional fitting has the same limit
    for _ in range(500):
        m *= (np.array([300.0, 700]) / m.sum(1))[:, None]
        m *= np.array([800.0, 200]) / m.sum(0)
    assert all(abs(tokens[g] * rate[g] - m[g[0] - 1, g[1] - 3]) < 1e-6 for g in tokens)
    import pytest

    with pytest.raises(RuntimeError):
        newton(spark, cells, spark.createDataFrame([(1, 300.0), (2, 700.0), (3, 100.0), (4, 200.0)], "group int, target double"), Workspace(spark, "t"))


def test_mix_of_repeated_rows(spark):
    """One document that is most of a source: as many of its rows get a copy as are due."""
    rows = [(1, "a", "x y z")] * 500 + [(2, "a", "x")] * 3 + [(3, "b", "w " * 4000), (None, None, "n"), (None, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = mix(spark, df).collect()
    assert len(got) == len(rows)
    for s in ("a", "b", None):
        mine = [x for x in got if x["source"] == s]
        assert abs(sum(x["taken"] for x in mine) - mine[0]["target"]) <= max(x["size"] for x in mine) / 2, s
    out = mixed(spark, df).collect()
    for s in ("a", "b", None):
        assert sum(len(x["text"].split()) for x in out if x["source"] == s) == sum(x["taken"] for x in got if x["source"] == s)


def test_mix_where_the_cut_falls_between_documents(spark):
    """Equal sizes, and a share that is a whole number of documents: the last range is not looked into."""
    rows = [(k, "a" if k % 3 else "b", " ".join(["w"] * 60)) for k in range(40)]
    got = mix(spark, spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    for s in "ab":
        mine = [x for x in got if x["source"] == s]
        assert abs(sum(x["taken"] for x in mine) - mine[0]["target"]) <= 30, s
