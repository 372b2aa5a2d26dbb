"""SentencePiece encoding and decoding by a max-plus parallel scan (op 8).

The vocabulary is a SentencePiece BPE model with byte fallback, so the result
to match is the library's: merges by score, leftmost first. A segmentation is
that result exactly if every two neighbouring pieces are stable, i.e. merging
their joined characters gives the two pieces back. So encoding is a best-path
problem over (position, last piece): a step to a piece weighs 0 if it is stable
after the last one and minus infinity if not, and the best path is unique.

Between two characters that no piece of the vocabulary spans (before a word's
space mark, around line breaks) paths decouple; such stretches are solved once
and remembered. Documents above ``GIANT`` characters are split into chunks of
``CHUNK`` that are dealt over the cluster:

1. each chunk yields the max-plus matrix from its entry states (a piece that
   ends at or straddles its first position) to its exit states;
2. the matrices of a document are combined associatively, which fixes the
   states at all boundaries (a few numbers per chunk);
3. each chunk is traced back on its own between its two states.

Texts are not changed: a literal space mark (U+2581) is written as bytes, so
decoding returns every text exactly.

Defined results: null and empty texts have no pieces and decode to the empty
text; rows are independent, repeated ids and further columns pass through
(those named like the columns made here are replaced).
"""
from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import saved

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT = 1 << 16
CHUNK = 1 << 15
MARK = "▁"
_LITERAL = "\ud800"       # stands for a literal space mark; valid texts cannot hold it
_ATOM = re.compile(f"\n+|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
_CACHE_ATOM = 48
REMEMBER = 800_000        # stretches that a worker remembers, about 250 bytes each
_NEVER = float("-inf")

State = tuple[int, str]   # characters beyond the boundary that are already covered, last piece


@dataclass
class Vocabulary:
    score: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    raw: list[bytes]                      # bytes of each id when decoding
    longest: dict[str, int] = field(default_factory=dict)
    inside: set[str] = field(default_factory=set)    # character pairs inside pieces
    starts: dict[str, bool] = field(default_factory=dict)   # beginnings of pieces; whether they are pieces
    stable: dict[str, dict[str, bool]] = field(default_factory=dict)
    atoms: dict[str, bytes] = field(default_factory=dict)
    coded: dict[str, bytes] = field(default_factory=dict)
    room: int = REMEMBER

    @classmethod
    def load(cls, path: str = MODEL, room: int = REMEMBER) -> Vocabulary:
        """Read the pieces on the driver; the vocabulary has a fixed size."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        score, ids, raw, byte_ids = {}, {}, [], [0] * 256
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
                raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                score[p], ids[p] = sp.get_score(i), i
                raw.append(p.replace(MARK, " ").encode())
        if any(re.search(f"[^{MARK}]{MARK}|\n.|.\n", p, re.S) for p in score):
            raise ValueError("pieces of this model span word or line boundaries")
        longest: dict[str, int] = {}
        inside: set[str] = set()
        starts: dict[str, bool] = {}
        for p in score:
            longest[p[0]] = max(longest.get(p[0], 1), len(p))
            inside.update(p[i:i + 2] for i in range(len(p) - 1))
            for i in range(2, len(p) + 1):
                starts[p[:i]] = starts.get(p[:i], False) or i == len(p)
        return cls(score, ids, byte_ids, raw, longest, inside, starts, room=room)

    def __getstate__(self):   # what was remembered stays with the worker
        return self.__dict__ | {"stable": {}, "atoms": {}, "coded": {}}

    def merge(self, text: str) -> list[str]:
        """Merge a short string: best score first, leftmost among equals."""
        s = list(text)
        while len(s) > 1:
            best, at = _NEVER, -1
            for i in range(len(s) - 1):
                x = self.score.get(s[i] + s[i + 1])
                if x is not None and x > best:
                    best, at = x, i
            if at < 0:
                break
            s[at:at + 2] = [s[at] + s[at + 1]]
        return s

    def follows(self, last: str, piece: str) -> bool:
        """Whether ``piece`` is stable after ``last`` ('' at a decoupled start);
        remembered in ``stable[last][piece]``."""
        known = self.stable.get(last)
        if known is None:
            known = self.stable[last] = {}
        ok = known.get(piece)
        if ok is None:
            ok = known[piece] = self.merge(last + piece) == ([last, piece] if last else [piece])
        return ok

    def paths(self, text: str, start: State, stop: int) -> list[tuple[int, str] | None]:
        """Best paths from a state: for each position the (previous position,
        piece) of the path that reaches it, or None. Positions up to ``stop``
        are extended; pieces may end beyond it, up to the end of ``text``."""
        n = len(text)
        back: list = [None] * (n + 1)
        last: list = [None] * (n + 1)
        at, piece = start
        last[at] = piece
        score, longest, stable, follows, nothing = self.score, self.longest, self.stable, self.follows, {}
        for p in range(at, stop):
            prev = last[p]
            if prev is None:
                continue
            known = stable.get(prev, nothing)
            far = p + longest.get(text[p], 1)
            for e in range(p + 1, (far if far < n else n) + 1):
                if last[e] is None:
                    t = text[p:e]
                    if t in score or e == p + 1:
                        ok = known.get(t)
                        if ok or ok is None and follows(prev, t):
                            last[e] = t
                            back[e] = (p, t)
        return back

    def trace(self, back: list, at: int, end: int) -> list[str]:
        out = []
        while end > at:
            end, t = back[end]
            out.append(t)
        return out[::-1]

    def wire(self, piece: str) -> bytes:
        """Ids of a piece as little-endian int32: its own, or those of its bytes."""
        known = self.coded.get(piece)
        if known is None:
            i = self.ids.get(piece)
            ids = [i] if i is not None else [self.byte_ids[b] for b in (MARK if piece == _LITERAL else piece).encode()]
            known = np.array(ids, "<i4").tobytes()
            if i is not None:
                self.coded[piece] = known
        return known

    def to_ids(self, pieces: list[str]) -> bytes:
        known, wire = self.coded.get, self.wire
        return b"".join([known(t) or wire(t) for t in pieces])

    def solve(self, s: str) -> bytes:
        """Best path through a whole decoupled stretch. With weights of 0 and
        minus infinity any complete path is the best, so the lattice is explored
        lazily, longest pieces first; positions that lead nowhere are remembered
        (what reaches a position does not depend on the way, see :meth:`paths`)."""
        n, starts, stable, follows = len(s), self.starts.get, self.stable, self.follows
        dead: set[int] = set()
        path: list[str] = []
        open_ends: list[list[int]] = []
        p, last = 0, ""
        while p < n:
            ends = [p + 1]
            for e in range(p + 2, n + 1):
                piece = starts(s[p:e])
                if piece is None:
                    break
                if piece:
                    ends.append(e)
            while True:
                known = stable.get(last)
                if known is None:
                    known = stable[last] = {}
                while ends:
                    e = ends.pop()
                    if e not in dead:
                        t = s[p:e]
                        ok = known.get(t)
                        if ok or ok is None and follows(last, t):
                            break
                else:
                    dead.add(p)
                    ends = open_ends.pop()
                    p -= len(path.pop())
                    last = path[-1] if path else ""
                    continue
                break
            open_ends.append(ends)
            path.append(t)
            p, last = e, t
        return self.to_ids(path)

    def atom(self, s: str) -> bytes:
        """Ids (as little-endian int32) of a decoupled stretch, cut further at
        character pairs that no piece holds."""
        if len(self.atoms) >= self.room:
            self.atoms.clear()
            self.stable.clear()
        if s[1:].isalpha() and len(s) <= _CACHE_ATOM:    # a plain word: hardly ever cut
            ids = self.atoms[s] = self.solve(s)
            return ids
        inside, atoms, lo, parts = self.inside, self.atoms, 0, []
        for i in range(1, len(s)):
            if s[i - 1:i + 1] not in inside:
                parts.append(s[lo:i])
                lo = i
        parts.append(s[lo:])
        out = []
        for x in parts:
            ids = atoms.get(x)
            if ids is None:
                ids = self.solve(x)
                if len(x) <= _CACHE_ATOM:
                    atoms[x] = ids
            out.append(ids)
        ids = b"".join(out)
        if len(s) <= _CACHE_ATOM:
            atoms[s] = ids
        return ids

    def encode(self, marked: str) -> bytes:
        atom = self.atom
        known = self.atoms.get
        return b"".join([known(s) or atom(s) for s in _ATOM.findall(marked)])

    def decode(self, ids: np.ndarray) -> str:
        return text_of(self.raw, ids)


def text_of(raw: list[bytes], ids: np.ndarray) -> str:
    """The text that ``ids`` stand for; ``raw`` holds the bytes of each id."""
    text = b"".join([raw[i] for i in ids.tolist()])
    return text[1:].decode() if text else ""


def marked(text: str) -> str:
    """The text as it is segmented: a space mark in front and for every space."""
    return MARK + text.replace(MARK, _LITERAL).replace(" ", MARK) if text else ""


# ---- chunks of giant documents

def entry_states(v: Vocabulary, before: str, chunk: str) -> list[State]:
    """States at the boundary between ``before`` (the end of the previous chunk)
    and ``chunk``: every piece that ends at or spans the boundary."""
    both = before + chunk
    at = len(before)
    out = []
    reach = max(v.longest.values(), default=1)
    for begin in range(max(0, at - reach), at):
        for end in range(at, min(len(both), begin + reach) + 1):
            t = both[begin:end]
            if len(t) == 1 or t in v.score:
                out.append((end - at, t))
    return out


def _decoupled(text: str, lo: int, hi: int) -> tuple[int, int] | None:
    """First and last positions in [lo, hi] that no piece spans."""
    ok = [m.start() for m in _ATOM.finditer(text) if lo <= m.start() <= hi and m.start() > 0]
    return (ok[0], ok[-1]) if ok else None


def transfer(v: Vocabulary, text: str, size: int, ins: list[State], outs: list[State]) -> list[list[float]]:
    """Max-plus matrix of a chunk: weight of the best path from each entry to
    each exit state. ``text`` is the chunk (``size`` characters) and a look-ahead
    of at most a piece."""
    reach = max(v.longest.values(), default=1)
    cut = _decoupled(text, reach, size - reach)
    if cut is None:
        rows = []
        for s in ins:
            back = v.paths(text, s, size)
            rows.append([0.0 if _reached(back, s, (size + o, t)) else _NEVER for o, t in outs])
        return rows
    # all paths meet at decoupled positions: the matrix is an outer sum of an entry and an exit vector
    first, last = cut
    head = [0.0 if v.paths(text[:first], s, first)[first] or s[0] == first else _NEVER for s in ins]
    rest = text[last:]
    back = v.paths(rest, (0, ""), size - last)
    tail = [0.0 if _reached(back, (0, ""), (size - last + o, t)) else _NEVER for o, t in outs]
    return [[a + b for b in tail] for a in head]


def _reached(back: list, start: State, end: State) -> bool:
    at, piece = end
    return (at, piece) == start or (at < len(back) and back[at] is not None and back[at][1] == piece)


def combine(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    """Max-plus product."""
    return [[max((x + b[k][j] for k, x in enumerate(row)), default=_NEVER) for j in range(len(b[0]))] for row in a]


def settle(matrices: list[list[list[float]]]) -> list[int]:
    """Index of the state at every boundary on the best path of the whole
    document, from prefix products and a walk back."""
    prefix = [matrices[0]]
    for m in matrices[1:]:
        prefix.append(combine(prefix[-1], m))
    states = [0]
    for k in range(len(matrices) - 1, 0, -1):
        scores = [prefix[k - 1][0][i] + matrices[k][i][states[-1]] for i in range(len(matrices[k]))]
        states.append(max(range(len(scores)), key=scores.__getitem__))
    return [0, *states[::-1]]


def chunk_path(v: Vocabulary, text: str, size: int, start: State, end: State) -> bytes:
    """Ids of the pieces that begin in a chunk, between two boundary states."""
    at, stop = start[0], size + end[0]
    parts = []
    reach = max(v.longest.values(), default=1)
    cut = _decoupled(text, reach, size - reach)
    if cut:
        first, last = cut
        parts += [v.to_ids(v.trace(v.paths(text[:first], start, first), at, first)), v.encode(text[first:last])]
        text, at, stop, start, size = text[last:], 0, stop - last, (0, ""), size - last
    parts.append(v.to_ids(v.trace(v.paths(text, start, size), at, stop)))
    return b"".join(parts)


def _chunks(documents: DataFrame, v, size: int) -> DataFrame:
    """(row, part, parts, before, text, size): chunks of ``documents`` (row, text)."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach = max(v.value.longest.values(), default=1)
        for pdf in batches:
            for row, text in zip(pdf["row"], pdf["text"], strict=True):
                s = marked(text)
                n = -(-len(s) // size)
                for k in range(n):
                    part = s[k * size:(k + 1) * size + reach]
                    yield pd.DataFrame({"row": [row], "part": [k], "parts": [n], "before": [_wire(s[max(0, k * size - reach):k * size])],
                                        "text": [_wire(part)], "size": [min(size, len(s) - k * size)]})

    return documents.mapInPandas(cut, "row long, part long, parts long, before binary, text binary, size long")


def _wire(s: str) -> bytes:
    return s.encode("utf-8", "surrogatepass")


def _unwire(b: bytes) -> str:
    return b.decode("utf-8", "surrogatepass")


def _states(v: Vocabulary, before: str, text: str, size: int, part: int, parts: int) -> tuple[list[State], list[State]]:
    ins = entry_states(v, before, text) if part else [(0, "")]
    if part == parts - 1:
        reach = max(v.longest.values(), default=1)
        outs = [(0, text[b:size]) for b in range(max(0, size - reach), size) if size - b == 1 or text[b:size] in v.score]
        if part and size <= reach:   # the last chunk may be covered by a piece that begins before it
            outs += [s for s in ((o - size, t) for o, t in ins if o == size) if s not in outs]
    else:
        outs = entry_states(v, text[:size][-max(v.longest.values(), default=1):] if size else "", text[size:])
    return ins, outs


def _encode_giants(documents: DataFrame, v, size: int) -> DataFrame:
    """(row, ids binary) of giant documents (row, text)."""
    chunks = saved(_chunks(documents, v, size).repartition("row", "part"), "chunks")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                text, before = _unwire(r.text), _unwire(r.before)
                ins, outs = _states(v.value, before, text, r.size, r.part, r.parts)
                m = transfer(v.value, text, r.size, ins, outs)
                if r.part == r.parts - 1:   # any last piece that ends the text will do
                    m = [[max(row, default=_NEVER)] for row in m]
                out.append((r.row, r.part, pickle.dumps(m)))
            yield pd.DataFrame(out, columns=["row", "part", "matrix"])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        states = settle([pickle.loads(m) for m in pdf["matrix"]])
        return pd.DataFrame({"row": pdf["row"], "part": pdf["part"], "start": states[:-1], "stop": states[1:]})

    bounds = chunks.mapInPandas(measure, "row long, part long, matrix binary").groupBy("row").applyInPandas(
        scan, "row long, part long, start int, stop int")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                text, before = _unwire(r.text), _unwire(r.before)
                ins, outs = _states(v.value, before, text, r.size, r.part, r.parts)
                end = (0, "") if r.part == r.parts - 1 else outs[r.stop]
                out.append((r.row, r.part, chunk_path(v.value, text, r.size, ins[r.start], end)))
            yield pd.DataFrame(out, columns=["row", "part", "ids"])

    parts = chunks.join(bounds, ["row", "part"]).mapInPandas(walk, "row long, part long, ids binary")
    whole = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("parts"))
    return whole.select("row", F.expr("aggregate(transform(parts, p -> p.ids), cast('' as binary), (a, b) -> concat(a, b))").alias("ids"))


def _ints(values: list[bytes]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(values), "<i4")))


def encode(documents: DataFrame, model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, remember: int = REMEMBER) -> DataFrame:
    """``documents`` with ``ids`` (array<int>) added, from the whole ``text``.
    ``remember`` bounds the memory of a worker's solved stretches; it changes
    only the time taken."""
    spark = documents.sparkSession
    v = spark.sparkContext.broadcast(Vocabulary.load(model, remember))
    names = [c for c in documents.columns if c not in ("ids", "_ids", "_row")]
    documents = documents.select(*names)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + ", ids array<int>"

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for lo in range(0, max(len(column), 1), 512):
                part = batch.slice(lo, 512)
                ids = [v.value.encode(marked(t)) if t else b"" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, _ints(ids)], [*names, "ids"])

    big = F.coalesce(F.length("text") > giant, F.lit(False))
    done = documents.where(~big).mapInArrow(small, ddl)
    # the row number is fixed by writing the giants once
    giants = saved(documents.where(big).withColumn("_row", F.monotonically_increasing_id()), "giants")
    found = _encode_giants(giants.select(F.col("_row").alias("row"), "text"), v, chunk)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 16):
                part = batch.slice(lo, 16)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), _ints(part.column("_ids").to_pylist())], [*names, "ids"])

    joined = giants.join(found.select(F.col("row").alias("_row"), F.col("ids").alias("_ids")), "_row").select(*names, "_ids")
    return done.unionByName(joined.mapInArrow(unpack, ddl))


def decode(encoded: DataFrame, model: str = MODEL, column: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ``ids`` stand for in ``column``."""
    spark = encoded.sparkSession
    raw = spark.sparkContext.broadcast(Vocabulary.load(model).raw)   # no worker needs more to decode
    names = [c for c in encoded.columns if c != column]
    encoded = encoded.select(*names)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + f", `{column}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(lo, 512)
                ids = part.column("ids")
                flat, ends = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths().fill_null(0)))])
                texts = [text_of(raw.value, flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, column])

    return encoded.mapInArrow(run, ddl)
