"""Language identification with spans for mixed-language text (op 5).

Words are scored, not documents; a run without a space is cut at changes of the
script and, if longer than ``GRAM_SPAN`` bytes, into consecutive words, so that
every byte counts; all Unicode white space separates. The script of a word's first letter narrows
the candidate languages (a language is a candidate for a script in which a
share of its training words is written); each candidate gets the naive Bayes
log-likelihood of the word's character n-grams. A Viterbi pass over the words
of the whole text, with a penalty for every switch, labels spans. A document
that opens and closes in one language has that language; else the one whose
spans weigh most.

The tables are learned from a bounded sample of labelled documents
(``per_lang`` of each language, chosen by a hash of the id) and have a fixed
size; prediction runs in Arrow batches inside the scan, without a shuffle.

Defined results: null texts and texts without a letter are ``und`` with score
0; without labelled documents everything is ``und``; rows are independent, so
repeated ids and further columns do not matter.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import Bytes, Words, cut_runs, held_out, lowered, mix, prefix_hash, slices, spaced, span_hash, words

PER_LANG = 1500          # labelled documents of each language used for learning
GRAM_BUCKETS = 1 << 17
GRAM_SPAN = 16
GRAM_SIZES = (2, 3, 4)
SWITCH = 12.0            # cost, in nats, of changing the language between words
SCRIPT_SHARE = 0.01
GROUP = 8                # slices of text that share a Viterbi pass
_LETTER = re.compile(r"[^\W\d_]")

# Script ranges by first code point (fixed values of the Unicode block table).
SCRIPTS = (
    ("latin", 0x0041), ("greek", 0x0370), ("cyrillic", 0x0400), ("armenian", 0x0530), ("hebrew", 0x0590),
    ("arabic", 0x0600), ("indic", 0x0900), ("thai", 0x0E00), ("georgian", 0x10A0), ("hangul", 0x1100),
    ("ethiopic", 0x1200), ("latin", 0x1E00), ("greek", 0x1F00), ("other", 0x2000), ("kana", 0x3040),
    ("other", 0x3100), ("han", 0x3400), ("other", 0xA000), ("hangul", 0xAC00), ("other", 0xD7B0),
    ("han", 0x20000),
)
_NAMES = tuple(dict.fromkeys(n for n, _ in SCRIPTS))
_STARTS = np.array([s for _, s in SCRIPTS])
_CODE = np.array([_NAMES.index(n) for n, _ in SCRIPTS])


def scripts(b: Bytes, w: Words) -> np.ndarray:
    """Script code of each word's first letter-like byte sequence, -1 if it has none."""
    d = b.data
    n = len(d)
    if not len(w.start):
        return np.zeros(0, np.int64)
    letter = ((d >= 65) & (d <= 90)) | ((d >= 97) & (d <= 122)) | (d >= 0xC3)
    # position of the first letter at or after each byte
    at = np.where(letter, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    p = at[w.start]
    ok = p < w.end
    p = np.where(ok, p, w.start)
    pad = np.concatenate([d, np.zeros(4, np.uint8)]).astype(np.int64)
    return np.where(ok, _script_at(pad, p), -1)


def _script_at(pad: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Script code of the characters that start at ``p``."""
    b0, b1, b2, b3 = pad[p], pad[p + 1] & 63, pad[p + 2] & 63, pad[p + 3] & 63
    cp = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 31) << 6 | b1, np.where(
        b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3)))
    return _CODE[np.maximum(0, np.searchsorted(_STARTS, cp, "right") - 1)]


def script_changes(b: Bytes, w: Words) -> np.ndarray:
    """Positions inside words at which a letter of another script follows."""
    d = b.data
    lead = np.flatnonzero(d >= 0xC3)
    pad = np.concatenate([d, np.zeros(4, np.uint8)]).astype(np.int64)
    kind = _script_at(pad, lead)
    latin, other = _NAMES.index("latin"), _NAMES.index("other")
    if not ((kind != latin) & (kind != other)).any():
        return np.zeros(0, np.int64)
    ascii_ = np.flatnonzero(((d >= 65) & (d <= 90)) | ((d >= 97) & (d <= 122)))
    at = np.concatenate([lead, ascii_])
    kind = np.concatenate([kind, np.full(len(ascii_), latin)])
    order = np.argsort(at, kind="stable")
    at, kind = at[order], kind[order]
    at, kind = at[kind != other], kind[kind != other]
    run = np.searchsorted(w.start, at, "right")
    return at[1:][(kind[1:] != kind[:-1]) & (run[1:] == run[:-1])]


def _cut(b: Bytes, c: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of a slice and how far their n-grams reach."""
    w = words(b)
    return cut_runs(b, w, c, GRAM_SPAN, max(GRAM_SIZES) - 1, script_changes(b, w))


def _grams(c: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """(words, k) buckets of the character n-grams of each word; -1 where absent.
    The whole word and its first bytes count apart."""
    cols = [span_hash(c, s, e) % np.uint64(GRAM_BUCKETS)]
    cols = [cols[0].astype(np.int64)]
    for size in GRAM_SIZES:
        for j in range(GRAM_SPAN - size + 1):
            ok = s + j + size <= e
            a = np.where(ok, s + j, s)
            h = span_hash(c, a, np.where(ok, a + size, a))
            if j == 0:
                h = mix(h ^ np.uint64(0xA5A5))
            cols.append(np.where(ok, (h % np.uint64(GRAM_BUCKETS)).astype(np.int64), -1))
    return np.stack(cols, 1)


@dataclass
class Model:
    langs: tuple[str, ...]
    logp: np.ndarray      # (GRAM_BUCKETS + 1, k); the last row is zero (absent n-gram)
    allowed: np.ndarray   # (scripts, k) candidate languages of each script


def train(texts: list[str], langs: list[str]) -> Model:
    """Count hashed n-grams of words by language."""
    names = tuple(sorted(set(langs)))
    k = len(names)
    counts = np.full((GRAM_BUCKETS, max(k, 1)), 0.5)
    by_script = np.zeros((len(_NAMES), max(k, 1)))
    for i, name in enumerate(names):
        column = pa.array([t for t, lang in zip(texts, langs, strict=True) if lang == name], pa.large_string())
        for b in map(spaced, slices(column)):
            c = prefix_hash(lowered(b))
            w, reach = _cut(b, c)
            kind = scripts(b, w)
            real = kind >= 0
            if not real.any():
                continue
            by_script[:, i] += np.bincount(kind[real], minlength=len(_NAMES))
            _, at, many = np.unique(w.hash[real], return_index=True, return_counts=True)
            g = _grams(c, w.start[real][at], reach[real][at])
            weight = np.broadcast_to(many[:, None], g.shape)[g >= 0]
            counts[:, i] += np.bincount(g[g >= 0], weights=weight, minlength=GRAM_BUCKETS)
    logp = np.log(counts / counts.sum(0))
    logp -= logp.mean(1, keepdims=True)
    share = by_script / np.maximum(by_script.sum(0), 1)
    allowed = share >= SCRIPT_SHARE
    allowed[~allowed.any(1)] = True
    return Model(names, np.concatenate([logp, np.zeros((1, max(k, 1)))]).astype(np.float32), allowed)


def word_scores(model: Model, b: Bytes, w: Words, c: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, k) log-likelihoods (0 for words without letters, -inf-like for
    languages that the script excludes) and the scripts."""
    kind = scripts(b, w)
    _, at, ids = np.unique(w.hash, return_index=True, return_inverse=True)
    g = _grams(c, w.start[at], reach[at])
    score = model.logp[g[:, 0]].copy()
    n = (g >= 0).sum(1)
    for j in range(1, g.shape[1]):
        score += model.logp[g[:, j]]       # -1 is the zero row
    score *= (3.0 / np.maximum(n, 3))[:, None]  # n-grams of a word are not independent
    out = score[ids.reshape(-1)]
    out[kind < 0] = 0
    real = kind >= 0
    out[real] = np.where(model.allowed[kind[real]], out[real], np.float32(-1e3))
    return out, kind


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word of every document (documents are rows
    ``first[i]:first[i+1]`` of ``scores``) under a penalty for each switch.
    Documents advance together, the longest first, so a step touches only those
    that still have words."""
    n = np.diff(first)
    total, k = scores.shape
    kind = np.int8 if k <= 128 else np.int32     # of a label
    labels = np.zeros(total, kind)
    if not total:
        return labels
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    active = np.searchsorted(-n, -np.arange(n[0]), "left")  # documents with more than t words
    stay = np.zeros((total, k), bool)    # whether the best way to a state keeps its label
    came = np.zeros(total, kind)         # else the label it comes from
    v = np.zeros((len(n), k))
    for t in range(n[0]):
        m = active[t]
        at = begin[:m] + t
        if t:
            top = v[:m].argmax(1)
            best = v[np.arange(m), top] - switch
            keep = v[:m] >= best[:, None]
            stay[at] = keep
            came[at] = top
            np.maximum(v[:m], best[:, None], out=v[:m])
        v[:m] += scores[at]
    state = v.argmax(1)
    for t in range(n[0] - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        labels[at] = state[:m]
        if t:
            state[:m] = np.where(stay[at, state[:m]], state[:m], came[at])
    return labels


def label(model: Model, parts: list[Bytes]) -> list[tuple[Words, np.ndarray, np.ndarray]]:
    """For each slice: its words, their language labels, and their weights
    (bytes; 0 without letters). One Viterbi pass serves all slices."""
    cut, scored = [], []
    for b in map(spaced, parts):
        c = prefix_hash(lowered(b))
        w, reach = _cut(b, c)
        cut.append(w)
        scored.append(word_scores(model, b, w, c, reach))
    base = np.cumsum([0] + [len(w.start) for w in cut])
    first = np.concatenate([w.first[:-1] + n for w, n in zip(cut, base, strict=False)] + [base[-1:]])
    labels = viterbi(np.concatenate([x for x, _ in scored]), first)
    return [(w, labels[base[i]:base[i + 1]], np.where(kind >= 0, w.end - w.start, 0))
            for i, (w, (_, kind)) in enumerate(zip(cut, scored, strict=True))]


def decide(labels: np.ndarray, weight: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Language index of each document and the share of its weight in spans of
    that language. A text that opens and closes in one language is in that
    language, whatever it quotes in between; else the heaviest one is."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    mass = np.bincount(doc * k + labels, weights=weight, minlength=len(n) * k).reshape(-1, k)
    best = mass.argmax(1)
    real = np.flatnonzero(weight > 0)
    if len(real):
        d = doc[real]
        opens, closes = np.full(len(n), -1), np.full(len(n), -2)
        opens[d[::-1]] = labels[real[::-1]]
        closes[d] = labels[real]
        best = np.where(opens == closes, opens, best)
    return best, mass[np.arange(len(n)), best] / np.maximum(mass.sum(1), 1)


def training_rows(documents: DataFrame, per_lang: int = PER_LANG) -> tuple[list[str], list[str]]:
    """At most ``per_lang`` documents of each language that are not held out,
    chosen by a hash of the id."""
    known = documents.select("doc_id", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out()).distinct()
    langs = sorted(r[0] for r in known.select("lang").distinct().collect())   # one row per language
    picks = [known.where(F.col("lang") == lang).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_lang) for lang in langs]
    if not picks:
        return [], []
    chosen = picks[0]
    for pick in picks[1:]:
        chosen = chosen.unionByName(pick)
    # at most per_lang ids of each language, one row of each
    rows = (documents.select("doc_id", "lang", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
            .groupBy("doc_id", "lang").agg(F.min("text").alias("text")).toPandas().sort_values(["lang", "doc_id"]))
    return list(rows["text"]), list(rows["lang"])


def fit(documents: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    texts, langs = training_rows(documents, per_lang)
    return train(texts, langs) if texts else None


def _runs(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal labels."""
    cut = np.flatnonzero(np.diff(labels)) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(labels)]])


def identify(documents: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), spans: bool = False) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (share of the text's words,
    by weight, inside spans of that language) for every row; with ``spans`` also
    an array of (start, end, lang) byte ranges that cover the words."""
    spark = documents.sparkSession
    cols = [c for c in keep if c != "text"]
    fields = [documents.schema[c] for c in keep]
    shared = spark.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            text = batch.column("text")
            pred = np.full(len(text), "und", object)
            score = np.zeros(len(text))
            found: list[list[dict]] = [[] for _ in range(len(text))]
            parts = list(slices(text)) if m else []
            for lo in range(0, len(parts), GROUP):
                group = parts[lo:lo + GROUP]
                for b, (w, labels, weight) in zip(group, label(m, group), strict=True):
                    best, share = decide(labels, weight, w.first, len(m.langs))
                    for i in np.flatnonzero(share > 0):
                        if not _LETTER.search(text[b.lo + int(i)].as_py()):
                            continue
                        pred[b.lo + i] = m.langs[best[i]]
                        score[b.lo + i] = share[i]
                        if spans:
                            x, y = w.first[i], w.first[i + 1]
                            found[b.lo + i] = [
                                {"start": int(w.start[x + s] - b.start[i]), "end": int(w.end[x + e - 1] - b.start[i]),
                                 "lang": m.langs[labels[x + s]]} for s, e in zip(*_runs(labels[x:y]), strict=True)]
            arrays = [batch.column(c) for c in keep] + [pa.array(pred, pa.string()), pa.array(score)]
            names = [*keep, "lang_pred", "score"]
            if spans:
                arrays, names = [*arrays, pa.array(found, span_type)], [*names, "spans"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"
    if spans:
        ddl += ", spans array<struct<start:bigint,end:bigint,lang:string>>"
    return documents.select(*cols, "text").mapInArrow(run, ddl)
