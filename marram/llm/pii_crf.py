"""Personal data (operator 2): base patterns, and a skip-chain conditional random field that labels what they leave.

Nodes are the tokens of a document that hold a digit or an at sign. Chain edges join neighbours; skip edges join the
occurrences, however far apart, of equal or similar tokens (same letters and digits, same last seven digits, or same address),
each to the next one, so a token that is clear in one place lends its label to the others. The field is trained here, by
pseudo-likelihood on a bounded sample whose labels are the base spans, with features dropped at random so that context and
skip edges carry weight of their own. Loopy message passing gives each token's marginals over the whole document; a token that
no base span covers is added where one kind is nearly certain.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches
from .spans import Span, span_rows, span_schema

BASE = ["email", "ip", "card", "phone"]
LABELS = ["none", *BASE]
#: Defaults of the training sample's bounds: ids, and the nodes of a document of it (longer ones are left out of the sample).
SAMPLE_DOCS, SAMPLE_NODES = 20_000, 200
#: Hash space of features, marginal from which a token is added, rounds of messages at most.
SPACE, CERTAIN, ROUNDS = 1 << 12, 0.95, 30

# The patterns of the base kinds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NODE_MARK = re.compile("[0-9@]")
_TOKEN = re.compile("[^\x20\x09-\x0d]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def emails(t: str) -> list[Span]:
    """Matches of local@domain: from each at sign, back over the local part, no further than the last match."""
    out, cursor, at = [], 0, t.find("@")
    while at >= 0:
        a = at
        while a > cursor and t[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(t, at + 1) if a < at else None
        if m:
            out.append((a, m.end(), "email"))
            cursor = m.end()
        at = t.find("@", max(at + 1, cursor))
    return out


def base_spans(t: str) -> list[Span]:
    out = emails(t) if "@" in t else []
    if not _NODE_MARK.search(t):
        return out
    for m in _IP.finditer(t):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(t):
        d = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


# ---------------------------------------------------------------- the field


def _strip(t: str, a: int, b: int) -> tuple[int, int]:
    """[a, b) without quotes and punctuation around the token."""
    while a < b and not (t[a].isalnum() or t[a] in "+("):
        a += 1
    while b > a and not t[b - 1].isalnum():
        b -= 1
    return a, b


def _shape(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub("[A-Za-z]", "a", re.sub("[0-9]", "0", s)))[:24]


def _possible(s: str, digits: int) -> int:
    """Bits of the labels that a token's structure allows."""
    could = [True, "@" in s, s.count(".") == 3 and 4 <= digits <= 12 and "@" not in s, 13 <= digits <= 19 and "." not in s and "@" not in s, 1 <= digits <= 15 and not re.search("[^0-9+().-]", s)]
    return sum(1 << k for k, x in enumerate(could) if x)


class Graph:
    """The nodes of a text (spans), the labels they may have (bits), features, and edges (first, second, 0 chain or 1 skip)."""

    def __init__(self, t: str):
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(t)] if _NODE_MARK.search(t) else []
        self.spans, self.features, self.edges, self.may = [], [], [], []
        last: dict[str, int] = {}
        before = None
        for k, (a, b) in enumerate(tokens):
            if not _NODE_MARK.search(t, a, b):
                continue
            i = len(self.spans)
            a, b = _strip(t, a, b)
            s = t[a:b]
            self.spans.append((a, b))
            digits = re.sub("[^0-9]", "", s)
            self.may.append(_possible(s, len(digits)))
            around = [t[slice(*tokens[j])].lower() if 0 <= j < len(tokens) else "" for j in (k - 2, k - 1, k + 1)]
            names = ["shape=" + _shape(s), f"digits={min(len(digits), 20)}", f"length={min(len(s), 40) // 4}", f"dots={min(s.count('.'), 4)}", f"at={'@' in s}", f"plus={s[:1] == '+'}"]
            if 12 <= len(digits) <= 19:
                names.append(f"luhn={luhn(digits)}")
            names += [f"{n}={_shape(x) if _NODE_MARK.search(x) else x[:12]}" for n, x in zip(("b2", "b1", "a1"), around, strict=True)]
            self.features.append([zlib.crc32(x.encode()) % SPACE for x in names])
            if before == k - 1 and i:
                self.edges.append((i - 1, i, 0))
            before = k
            if b > a:
                keys = {re.sub("[^a-z0-9@]", "", s.lower())}
                if len(digits) >= 7:
                    keys.add("#" + digits[-7:])
                for key in keys:
                    if len(key) >= 5:
                        if key in last and (last[key], i, 1) not in self.edges[-4:]:
                            self.edges.append((last[key], i, 1))
                        last[key] = i

    def labels(self, spans: list[Span]) -> np.ndarray:
        """The kind of the base span that each node overlaps, or 0."""
        y = np.zeros(len(self.spans), np.int64)
        spans, j = sorted(spans), 0
        for i, (a, b) in enumerate(self.spans):
            while j < len(spans) and spans[j][1] <= a:
                j += 1
            if j < len(spans) and spans[j][0] < b:
                y[i] = LABELS.index(spans[j][2])
        return y


def _barred(may: list[int]) -> np.ndarray:
    """0 for a label that a node may have, else a score that rules it out."""
    return np.where(np.array(may)[:, None] >> np.arange(len(LABELS)) & 1, 0.0, -30.0)


class Field:
    """Weights: unary (feature, label), pairwise (chain or skip, label, label)."""

    def __init__(self, unary: np.ndarray | None = None, pair: np.ndarray | None = None):
        k = len(LABELS)
        self.unary = np.zeros((SPACE, k)) if unary is None else unary
        self.pair = np.zeros((2, k, k)) if pair is None else pair

    def scores(self, features: list[list[int]], may: list[int]) -> np.ndarray:
        return np.array([self.unary[f].sum(0) for f in features]) + _barred(may)

    def train(self, sample: list[tuple[list[list[int]], list[int], list[tuple[int, int, int]], list[int]]], *, epochs: int = 12, rate: float = 0.2, keep: float = 0.4, decay: float = 1e-4, seed: int = 5) -> Field:
        """Pseudo-likelihood by AdaGrad: each node given its features (a share of them dropped) and its neighbours' labels."""
        rng, k = np.random.default_rng(seed), len(LABELS)
        gu, gp = np.full((SPACE, k), 1e-6), np.full((2, k, k), 1e-6)
        for _ in range(epochs):
            for d in rng.permutation(len(sample)):
                features, y, edges, may = sample[d]
                barred = _barred([m | 1 << label for m, label in zip(may, y, strict=True)])
                near: list[list[tuple[int, int]]] = [[] for _ in y]
                for a, b, kind in edges:
                    near[a].append((kind, y[b]))
                    near[b].append((kind, y[a]))
                for i, f in enumerate(features):
                    f = [x for x in f if rng.random() < keep]
                    s = self.unary[f].sum(0) + barred[i] + sum((self.pair[kind, other] for kind, other in near[i]), np.zeros(k))
                    p = np.exp(s - s.max())
                    g = p / p.sum()
                    g[y[i]] -= 1
                    for x in f:
                        d_ = g + decay * self.unary[x]
                        gu[x] += d_ * d_
                        self.unary[x] -= rate * d_ / np.sqrt(gu[x])
                    for kind, other in near[i]:
                        d_ = g + decay * self.pair[kind, other]
                        gp[kind, other] += d_ * d_
                        self.pair[kind, other] -= rate * d_ / np.sqrt(gp[kind, other])
        self.pair = (self.pair + self.pair.transpose(0, 2, 1)) / 2
        return self

    def marginals(self, features, edges, may, clamp: np.ndarray) -> np.ndarray:
        """Loopy sum-product with damping; nodes with a base label (clamp > 0) are held at it."""
        u = self.scores(features, may)
        held = np.flatnonzero(clamp)
        u[held] = -30.0
        u[held, clamp[held]] = 0.0
        if not edges:
            e = np.exp(u - u.max(1, keepdims=True))
            return e / e.sum(1, keepdims=True)
        a, b, kind = np.array(edges).T
        src, dst = np.r_[a, b], np.r_[b, a]
        w = np.exp(self.pair[np.r_[kind, kind]])
        back = np.r_[np.arange(len(a), 2 * len(a)), np.arange(len(a))]
        log_m = np.zeros((len(src), len(LABELS)))
        for _ in range(ROUNDS):
            belief = u.copy()
            np.add.at(belief, dst, log_m)
            out = belief[src] - log_m[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(np.einsum("ei,eij->ej", out, w) + 1e-300)
            new -= new.max(1, keepdims=True)
            new = 0.7 * new + 0.3 * log_m
            moved = np.abs(new - log_m).max()
            log_m = new
            if moved < 1e-4:
                break
        belief = u.copy()
        np.add.at(belief, dst, log_m)
        e = np.exp(belief - belief.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def find_personal(t: str, field: Field, certain: float = CERTAIN) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans) of a text; the added ones overlap no base span."""
    base = base_spans(t)
    g = Graph(t)
    if not g.spans:
        return base, []
    y = g.labels(base)
    if y.all():
        return base, []
    p = field.marginals(g.features, g.edges, g.may, y)
    best = p[:, 1:].argmax(1) + 1
    sure = np.flatnonzero((y == 0) & (p[np.arange(len(p)), best] >= certain))
    added = [(*g.spans[i], LABELS[best[i]]) for i in sure if g.spans[i][0] < g.spans[i][1]]
    return base, [x for x in added if x[2] != "phone" or sum(c.isdigit() for c in t[x[0] : x[1]]) >= 7]


def _sampler(most_nodes: int):
    def sample(batches):
        for batch in batches:
            rows = []
            for x in batch.column(1):
                t = x.as_py() or ""
                g = Graph(t)
                if 0 < len(g.spans) <= most_nodes:
                    rows.append((g.features, g.labels(base_spans(t)).tolist(), [list(e) for e in g.edges], g.may))
            ints = pa.list_(pa.int32())
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.list_(ints)), pa.array(cols[1], ints), pa.array(cols[2], pa.list_(ints)), pa.array(cols[3], ints)], names=["f", "y", "e", "may"])

    return sample


def train_field(spark: SparkSession, docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_nodes: int = SAMPLE_NODES) -> Field:
    """Fits the field on the `sample_docs` ids of least hash (all of a smaller table), of those the documents of at most
    `sample_nodes` nodes; only these come to the driver, as features. No documents: a field without weights."""
    bounded_batches(spark)
    ids = docs.select("doc_id").where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample_docs).select("doc_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id", "left_semi")  # at most sample_docs ids
    got = texts.mapInArrow(_sampler(sample_nodes), "f array<array<int>>, y array<int>, e array<array<int>>, may array<int>").collect()
    return Field().train(sorted(((r["f"], r["y"], [tuple(e) for e in r["e"]], r["may"]) for r in got), key=str))


def personal_data(spark: SparkSession, docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_nodes: int = SAMPLE_NODES, certain: float = CERTAIN) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans of each kind), base_sha256, spans for each row of docs (doc_id, text).

    Spans are [start, end) in code points of the whole text; a null or empty text has none. An empty table trains nothing and
    gives no rows; rows that share an id are scanned each.
    """
    field = train_field(spark, docs, sample_docs=sample_docs, sample_nodes=sample_nodes)
    weights = spark.sparkContext.broadcast((field.unary, field.pair))  # SPACE x 5 numbers
    rows = docs.select("doc_id", "text")

    def run(batches):
        f = Field(*weights.value)
        yield from span_rows(lambda t: find_personal(t, f, certain), BASE, BASE)(batches)

    return rows.mapInArrow(run, span_schema(dict(rows.dtypes)["doc_id"], BASE))
