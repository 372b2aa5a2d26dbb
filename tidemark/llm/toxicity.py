"""Toxicity scoring with a bidirectional gated recurrent network (op 1).

Every text is cut into overlapping windows of words; runs without a space that
are longer than ``WHOLE`` bytes are cut into consecutive words, so that every
byte is an input; all Unicode white space separates. A word enters the network
as the sum of a word embedding and of embeddings of its character n-grams (both
hashed); a forward and a backward gated recurrent layer run over the window, an
attention layer pools their states, and a logistic unit scores the window. The
score of a document is that of its worst window.

The network is trained in numpy on the driver from a bounded sample of labelled
documents (``per_class`` toxic and twice as many clean ones, chosen by a hash
of the id). A toxic
document teaches through its highest-scoring window, a clean one through its
highest-scoring and one further window. Scoring runs in Arrow batches inside
the scan of the documents, without a shuffle; the weights are broadcast and
have a fixed size (about 4 MB) whatever the input.

Defined results: null and empty texts score as an empty window; without
labelled rows of both classes every score is 0; repeated label rows of a
document count once (toxic if any says so); other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import Bytes, cut_runs, held_out, lowered, mix, prefix_hash, slices, spaced, span_hash, words

HIDDEN = 8
DIM = 8
WORD_BUCKETS = 1 << 16
GRAM_BUCKETS = 1 << 16
WINDOW = 64
STRIDE = 48
BLOCK = 2048       # windows per batch of the recurrent layer
PER_CLASS = 1500   # toxic documents used for training; twice as many clean ones
GRAM = 4
PREFIXES = (3, 4, 5, 6)
GRAM_SPAN = 12     # character n-grams starting in the first bytes of a word
WHOLE = GRAM_SPAN + GRAM - 1   # bytes that these n-grams cover; longer words are cut


@dataclass
class Model:
    """Weights; ``prior`` is set instead when there was nothing to learn from."""
    p: dict[str, np.ndarray] = field(default_factory=dict)
    prior: float | None = None


def _new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    h, d = HIDDEN, DIM
    scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else s[0])).astype(np.float32)
    return {
        "word": 0.05 * rng.standard_normal((WORD_BUCKETS, d)).astype(np.float32),
        "gram": 0.05 * rng.standard_normal((GRAM_BUCKETS, d)).astype(np.float32),
        "W": scale(2, d, 3 * h), "c": np.zeros((2, 1, 3 * h), np.float32),
        "U": scale(2, h, 3 * h),
        "att": scale(2 * h), "out": scale(2 * h), "bias": np.zeros(1, np.float32),
    }


@dataclass
class Vocabulary:
    """Distinct words of a slice: hashed features of each, and the words as indexes."""
    word: np.ndarray     # (u,)
    grams: np.ndarray    # (u, k) bucket, -1 where absent
    ids: np.ndarray      # index of every word of the slice
    first: np.ndarray    # as in text.Words


def vocabulary(b: Bytes) -> Vocabulary:
    b = spaced(b)
    c = prefix_hash(lowered(b))
    w, reach = cut_runs(b, words(b), c, WHOLE, GRAM - 1)
    _, at, ids = np.unique(w.hash, return_index=True, return_inverse=True)
    s, e = w.start[at], reach[at]
    cols = []
    for n in PREFIXES:
        ok = s + n <= e
        g = mix(span_hash(c, s, np.where(ok, s + n, e)) ^ np.uint64(0x5BD1E995)) % np.uint64(GRAM_BUCKETS)
        cols.append(np.where(ok, g.astype(np.int64), -1))
    for j in range(GRAM_SPAN):
        ok = s + j + GRAM <= e
        a = np.where(ok, s + j, s)
        g = span_hash(c, a, np.where(ok, a + GRAM, a)) % np.uint64(GRAM_BUCKETS)
        cols.append(np.where(ok, g.astype(np.int64), -1))
    return Vocabulary((w.hash[at] % np.uint64(WORD_BUCKETS)).astype(np.int64), np.stack(cols, 1), ids.reshape(-1), w.first)


def _inputs(p: dict[str, np.ndarray], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Input vector of each distinct word, and the weight of its n-grams."""
    has = (v.grams >= 0)
    share = (1 / np.sqrt(np.maximum(has.sum(1), 1))).astype(np.float32)
    x = p["word"][v.word].copy()
    for j in range(v.grams.shape[1]):
        x += p["gram"][v.grams[:, j]] * (has[:, j] * share)[:, None]
    return x, share


def _gates(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """(2, u + 1, 3h): the words' part of the gates for both directions; the last
    row is padding, whose update gate is shut."""
    g = np.empty((2, len(x) + 1, 3 * HIDDEN), np.float32)
    g[:, :-1] = x @ p["W"] + p["c"]
    g[:, -1] = 0
    g[:, -1, HIDDEN:2 * HIDDEN] = -40
    return g


def windows(first: np.ndarray, ids: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows of all documents: (n, WINDOW) word indexes and the
    document of each. A document without words has one empty window."""
    n = np.diff(first)
    many = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    at = (first[doc] + k * STRIDE)[:, None] + np.arange(WINDOW)
    ok = at < first[doc + 1][:, None]
    if not len(ids):
        return np.full(at.shape, pad, np.int64), doc
    return np.where(ok, ids[np.where(ok, at, 0)], pad), doc


def _forward(p: dict[str, np.ndarray], g: np.ndarray, idx: np.ndarray, keep: bool = False):
    """Logits of windows; with ``keep`` also what the backward pass needs."""
    b, t_all = idx.shape
    h2 = 2 * HIDDEN
    h = np.zeros((2, b, HIDDEN), np.float32)
    states = np.empty((2, t_all, b, HIDDEN), np.float32)
    kept = []
    cols = np.ascontiguousarray(idx.T)
    for t in range(t_all):
        gx = np.stack([g[0, cols[t]], g[1, cols[t_all - 1 - t]]])
        hu = h @ p["U"]
        rz = gx[:, :, :h2] + hu[:, :, :h2]
        rz *= 0.5
        np.tanh(rz, out=rz)
        rz += 1
        rz *= 0.5
        r, z = rz[:, :, :HIDDEN], rz[:, :, HIDDEN:]
        n = np.tanh(gx[:, :, h2:] + r * hu[:, :, h2:])
        new = h + z * (n - h)
        if keep:
            kept.append((h, r, z, n, hu[:, :, h2:]))
        h = new
        states[0, t] = h[0]
        states[1, t_all - 1 - t] = h[1]
    att = states[0] @ p["att"][:HIDDEN] + states[1] @ p["att"][HIDDEN:]
    att = np.where(cols == g.shape[1] - 1, np.float32(-1e4), att)
    att = np.exp(att - att.max(0))
    att /= att.sum(0)
    pooled = np.concatenate([np.einsum("tb,tbh->bh", att, states[0]), np.einsum("tb,tbh->bh", att, states[1])], 1)
    logit = pooled @ p["out"] + p["bias"][0]
    return (logit, (cols, states, att, pooled, kept)) if keep else (logit, None)


def _backward(p: dict[str, np.ndarray], x: np.ndarray, saved, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of all weights but the embeddings, and of the words' input vectors."""
    cols, states, att, pooled, kept = saved
    t_all, b = cols.shape
    h2 = 2 * HIDDEN
    grad = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
    dpool = dlogit[:, None] * p["out"]
    both = np.concatenate([states[0], states[1]], 2)
    datt = np.einsum("tbh,bh->tb", both, dpool)
    dscore = att * (datt - (att * datt).sum(0))
    grad["att"] = np.einsum("tb,tbh->h", dscore, both)
    dboth = att[:, :, None] * dpool + dscore[:, :, None] * p["att"]
    dg = np.zeros((2, len(x) + 1, 3 * HIDDEN), np.float32)
    grad["U"] = np.zeros_like(p["U"])
    carry = np.zeros((2, b, HIDDEN), np.float32)
    u_t = p["U"].transpose(0, 2, 1)
    for t in range(t_all - 1, -1, -1):
        h, r, z, n, hun = kept[t]
        dh = carry + np.stack([dboth[t, :, :HIDDEN], dboth[t_all - 1 - t, :, HIDDEN:]])
        dn = dh * z * (1 - n * n)
        dz = dh * (n - h) * z * (1 - z)
        dr = dn * hun * r * (1 - r)
        dhu = np.concatenate([dr, dz, dn * r], 2)
        dgx = np.concatenate([dr, dz, dn], 2)
        grad["U"] += h.transpose(0, 2, 1) @ dhu
        carry = dh * (1 - z) + dhu @ u_t
        np.add.at(dg[0], cols[t], dgx[0])
        np.add.at(dg[1], cols[t_all - 1 - t], dgx[1])
    dg = dg[:, :-1]
    grad["c"] = dg.sum(1, keepdims=True)
    grad["W"] = np.stack([x.T @ dg[0], x.T @ dg[1]])
    return grad, dg[0] @ p["W"][0].T + dg[1] @ p["W"][1].T


def train(texts: list[str], toxic: np.ndarray, epochs: int = 6, batch: int = 48, rate: float = 0.02, seed: int = 7) -> Model:
    """Fit the network by Adam on whole texts with document labels."""
    toxic = np.asarray(toxic)
    if not len(texts) or toxic.min() == toxic.max():
        return Model(prior=0.0)
    rng = np.random.default_rng(seed)
    p = _new_weights(rng)
    first = {k: np.zeros_like(a) for k, a in p.items()}
    second = {k: np.zeros_like(a) for k, a in p.items()}
    sides = [np.flatnonzero(toxic == k) for k in (0, 1)]
    share_of = (2 * batch // 3, batch // 3)   # clean, toxic
    steps = max(60, -(-len(texts) // batch))   # small samples are passed over more often
    total, step = 0, epochs * steps
    for _ in range(epochs):
        order = [rng.permutation(np.resize(s, steps * m)) for s, m in zip(sides, share_of, strict=True)]
        for k in range(steps):
            part = np.concatenate([o[k * m:(k + 1) * m] for o, m in zip(order, share_of, strict=True)])
            y = toxic[part]
            column = pa.array([texts[i] for i in part], pa.large_string())
            (b,) = slices(column, 1 << 62)
            v = vocabulary(b)
            x, share = _inputs(p, v)
            g = _gates(p, x)
            idx, doc = windows(v.first, v.ids, len(x))
            logit = np.concatenate([_forward(p, g, idx[i:i + BLOCK])[0] for i in range(0, len(idx), BLOCK)])
            rank = np.lexsort((logit, doc))
            last = np.append(np.flatnonzero(np.diff(doc[rank])), len(rank) - 1)
            chosen = rank[last]
            clean = np.flatnonzero(y[doc] == 0)
            chosen = np.unique(np.concatenate([chosen, rng.choice(clean, min(len(clean), batch), replace=False)]))
            logit, saved = _forward(p, g, idx[chosen], keep=True)
            want = y[doc[chosen]]
            d = (1 / (1 + np.exp(-logit)) - want).astype(np.float32)
            d[want == 1] /= max(1, (want == 1).sum())
            d[want == 0] /= max(1, (want == 0).sum())
            grad, dx = _backward(p, x, saved, d)
            grad["word"] = np.zeros_like(p["word"])
            np.add.at(grad["word"], v.word, dx)
            grad["gram"] = np.zeros_like(p["gram"])
            for j in range(v.grams.shape[1]):
                has = v.grams[:, j] >= 0
                np.add.at(grad["gram"], v.grams[has, j], dx[has] * share[has][:, None])
            total += 1
            lr = rate * min(1.0, 1.2 - total / step)
            for n, a in grad.items():
                first[n] += 0.1 * (a - first[n])
                second[n] += 0.01 * (a * a - second[n])
                p[n] -= (lr / (1 - 0.9 ** total)) * first[n] / (np.sqrt(second[n] / (1 - 0.99 ** total)) + 1e-6)
    return Model(p)


def score_slice(model: Model, b: Bytes) -> np.ndarray:
    """Toxicity of each row of a slice: the highest of its windows' scores."""
    if model.prior is not None:
        return np.full(len(b.start), model.prior)
    v = vocabulary(b)
    x, _ = _inputs(model.p, v)
    g = _gates(model.p, x)
    n = np.diff(v.first)
    best = np.full(len(n), -np.inf)
    # groups of documents whose windows fit a block or two
    many = np.cumsum(np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1))
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(many, (many[lo - 1] if lo else 0) + 2 * BLOCK, "right")))
        idx, doc = windows(v.first[lo:hi + 1], v.ids, len(x))
        for i in range(0, len(idx), BLOCK):
            np.maximum.at(best, lo + doc[i:i + BLOCK], _forward(model.p, g, idx[i:i + BLOCK])[0])
        lo = hi
    return 1 / (1 + np.exp(-best))


def training_rows(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[str], np.ndarray]:
    """At most ``per_class`` toxic and ``2 * per_class`` clean labelled documents
    that are not held out, chosen by a hash of the id."""
    known = (labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    picks = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(m)
             for k, m in ((0, 2 * per_class), (1, per_class))]
    chosen = picks[0].unionByName(picks[1])
    # at most 3 * per_class ids, one row of each
    rows = (documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).toPandas().sort_values("doc_id"))
    return list(rows["text"]), rows["toxic"].to_numpy(dtype=np.int64)


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    texts, toxic = training_rows(documents, labels, per_class)
    return train(texts, toxic)


def score(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1) for every row of ``documents``,
    from its whole ``text``."""
    spark = documents.sparkSession
    weights = spark.sparkContext.broadcast(model)
    cols = [c for c in keep if c != "text"]
    fields = [documents.schema[c] for c in keep]
    source = documents.select(*cols, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            parts = [score_slice(weights.value, b) for b in slices(text)]
            scores = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [scores], [*keep, "score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"
    return source.mapInArrow(run, ddl)
