"""Token ids in binary files, compressed by Re-Pair grammars (op 12).

Documents are put in ascending ``doc_id`` order by one range partitioning, encoded
with a public tokenizer, and each document's ids are followed by an end id. A
range is a shard; its ids are cut into blocks of whole documents of about
``BLOCK`` ids (a longer document is cut into blocks of its own). In each block
Re-Pair repeatedly replaces frequent pairs of neighbouring symbols by a new
symbol. A rule is kept with the length of its expansion, and no rule spans two
documents, so :func:`read_range` finds the symbols that cover any range of ids by
their cumulated lengths and expands only those.

One round replaces many pairs at once: pairs are counted in a hash table whose
slots hold one pair each (a pair that finds its slot taken waits for the next
round, which hashes differently), and a pair is replaced wherever it is more
frequent than both pairs that overlap it. Rounds end when no pair that occurs
``LEAST`` times is left or a round saves less than ``GAIN`` of the symbols.

A block's bytes (little-endian): magic ``RPG1``; u32 base, rounds, rules, symbols;
u64 ids; u8 width of a symbol, u8 width of a length; the first rule of each round
as u32; left sides, right sides, expansion lengths and symbols in these widths.
Symbols below ``base`` are ids, ``base + k`` is rule k. Blocks are the cells of a
Parquet table, ``blocks`` (shard, block, first, n_tokens, part, parts, doc_ids,
starts, sizes, grammar), beside ``shards`` (shard, first_token, n_tokens): Spark's
writer commits them, so a lost executor leaves no half file, and any store that
Spark writes to will do.

Memory is bounded by a block, a batch of texts and the longest text. Words are
cut at ``[\\x20\\x09-\\x0D]``, over which no token of this tokenizer reaches (its
pattern removes white space), and the ids of short ones are remembered per
worker, which changes the time only.

Defined results: null texts are empty (the end id alone); rows with a null
``doc_id`` come first; rows that repeat an id are documents of their own, ordered
by a hash of the text; further columns are ignored; an empty table gives an empty
directory of blocks that reads back as no rows.
"""
from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.curation import bounded_broadcast

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 2
BLOCK = 1 << 18      # ids in a block, about
LEAST = 3            # occurrences that pay for a rule
GAIN = 1 / 64
REMEMBER = 500_000   # words, and parts of words, whose ids a worker remembers, at most
STRETCH = 1 << 23    # bytes of text that are encoded at once
WORD = 64            # longer words are not remembered
SLOTS_LOG = 18
MAGIC = b"RPG1"
_HEAD = struct.Struct("<4sIIIIQBB")
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)

BLOCKS = ("shard int, block int, first long, n_tokens long, part int, parts int, doc_ids array<long>, starts array<long>, "
          "sizes array<long>, grammar binary")
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


@dataclass
class Grammar:
    base: int            # symbols below it are ids
    rounds: np.ndarray   # first rule of each round
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray   # ids a rule stands for
    symbols: np.ndarray
    n: int               # ids in all

    def lengths(self) -> np.ndarray:
        """Ids that each symbol stands for."""
        out = np.ones(len(self.symbols), np.int64)
        rule = self.symbols >= self.base
        out[rule] = self.length[self.symbols[rule] - self.base]
        return out

    def to_bytes(self) -> bytes:
        most = max(self.base + len(self.left) - 1, 0)
        wide, long = _width(most), _width(int(self.length.max(initial=0)))
        head = _HEAD.pack(MAGIC, self.base, len(self.rounds), len(self.left), len(self.symbols), self.n, wide, long)
        return b"".join((head, self.rounds.astype("<u4").tobytes(), _pack(self.left, wide), _pack(self.right, wide),
                         _pack(self.length, long), _pack(self.symbols, wide)))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Grammar:
        magic, base, rounds, rules, symbols, n, wide, long = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = _HEAD.size
        parts = []
        for count, width in ((rounds, 4), (rules, wide), (rules, wide), (rules, long), (symbols, wide)):
            parts.append(_unpack(raw, at, count, width))
            at += count * width
        return cls(base, *parts, n)


def _width(most: int) -> int:
    return max(1, (most.bit_length() + 7) // 8)


def _pack(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")[:, None].view(np.uint8)[:, :width]).tobytes() if len(values) else b""


def _unpack(raw: bytes, at: int, count: int, width: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, count * width, at).reshape(count, width)
    return out.view("<i8")[:, 0]


def compress(ids: np.ndarray, last: np.ndarray, base: int, least: int = LEAST, gain: float = GAIN) -> Grammar:
    """The grammar of ``ids`` (all below ``base``); ``last`` marks the ends of
    documents, which no rule spans."""
    seq, last = ids.astype(np.uint32), last.copy()
    length = [np.zeros(0, np.int64)]
    left, right, rounds, rules = [], [], [], 0
    sizes = np.ones(len(seq), np.int64)
    log = int(min(SLOTS_LOG, max(8, np.ceil(np.log2(max(len(seq), 1))))))
    slots = 1 << log
    slot_key = np.zeros(slots + 1, np.uint64)
    for k in range(1 << 30):
        if len(seq) < 2:
            break
        mixed = seq[:-1] * _ODD[k % 4] + seq[1:] * _ODD[(k + 1) % 4]
        mixed ^= mixed >> np.uint32(15)
        mixed *= _ODD[(k + 2) % 4]
        slot = (mixed >> np.uint32(32 - log)).astype(np.intp)
        key = seq[:-1].astype(np.uint64)
        key <<= np.uint64(32)
        key |= seq[1:]
        slot_key[slot] = key
        able = slot_key[slot] == key
        able &= ~last[:-1]
        np.copyto(slot, slots, where=~able)   # a slot for all pairs that are out of this round
        count = np.bincount(slot, minlength=slots + 1)
        count[slots] = 0
        weight = np.where(count >= least, (count << log) | np.arange(slots + 1), 0)   # equal only for equal pairs
        pick = _heaviest(weight[slot])
        at = slot[pick]
        made = np.bincount(at, minlength=slots + 1)
        pick = pick[made[at] >= least]
        if len(pick) == 0:
            break
        saved = len(pick) / len(seq)
        new = np.flatnonzero(made >= least)
        name = np.zeros(slots + 1, np.uint32)
        name[new] = base + rules + np.arange(len(new))
        rounds.append(rules)
        left.append((slot_key[new] >> np.uint64(32)).astype(np.int64))
        right.append((slot_key[new] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        sizes[pick] += sizes[pick + 1]
        by_rule = np.zeros(len(new), np.int64)
        seq[pick] = name[slot[pick]]
        by_rule[seq[pick].astype(np.int64) - base - rules] = sizes[pick]
        length.append(by_rule)
        last[pick] = last[pick + 1]
        rules += len(new)
        stay = np.ones(len(seq), bool)
        stay[pick + 1] = False
        seq, last, sizes = seq[stay], last[stay], sizes[stay]
        if saved < gain:
            break
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Grammar(base, np.array(rounds, np.int64), join(left), join(right), join(length), seq.astype(np.int64), len(ids))


def _heaviest(weight: np.ndarray) -> np.ndarray:
    """Places whose pair outweighs both that overlap it; among neighbours of equal
    weight, a run of one symbol, every second place."""
    w = np.zeros(len(weight) + 2, np.int64)
    np.left_shift(weight, 1, out=w[1:-1])
    w[1:-1:2] += weight[::2] > 0
    top = w[1:-1] > w[:-2]
    top &= w[1:-1] > w[2:]
    return np.flatnonzero(top)


def expand(g: Grammar, symbols: np.ndarray) -> np.ndarray:
    """The ids that ``symbols`` stand for; rules of a round use earlier ones only."""
    seq = symbols
    for first in g.rounds[::-1].tolist():
        rule = seq >= g.base + first
        if rule.any():
            at = np.flatnonzero(rule)
            k = seq[at] - g.base
            seq = np.repeat(seq, 1 + rule)
            at = at + np.arange(len(at))
            seq[at], seq[at + 1] = g.left[k], g.right[k]
    return seq


def read_range(g: Grammar, lo: int, hi: int) -> np.ndarray:
    """Ids [lo, hi) of a block, by expanding only the symbols that cover them."""
    if hi <= lo:
        return np.zeros(0, np.int64)
    ends = np.cumsum(g.lengths())
    a, z = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, hi, "left")) + 1
    skipped = int(ends[a - 1]) if a else 0
    return expand(g, g.symbols[a:z])[lo - skipped:hi - skipped]


# Words of printable ASCII but the apostrophe and of Latin-1 letters: the pattern of
# the tokenizer always cuts them between letters and other characters, and encodes
# the parts apart, each run of letters as one unit that ends in an end-of-word token.
_SAFE = "^[!-&(-~À-ÖØ-öø-ÿ]+$"
_CUTS = (("([a-zß-öø-ÿ])([!-&(-`{-~])", r"\1 \2"), ("([!-&(-`{-~])([a-zß-öø-ÿ])", r"\1 \2"))
_LETTERS = "^[a-zß-öø-ÿ]"
_SPECIAL = "<|"
TOGETHER = 2048          # runs of letters that are encoded as one text


@dataclass
class Ragged:
    """Lists of ids, one behind the other."""
    flat: np.ndarray
    size: np.ndarray

    def take(self, at: np.ndarray) -> Ragged:
        size = self.size[at]
        ends = np.cumsum(size)
        begin = (np.cumsum(self.size) - self.size)[at]
        n = int(ends[-1]) if len(ends) else 0
        return Ragged(self.flat[np.arange(n) + np.repeat(begin - ends + size, size)], size)   # lists in the order of ``at``

    def merged(self, offsets: np.ndarray) -> Ragged:
        """Lists ``offsets[i]:offsets[i + 1]`` as one each."""
        ends = np.concatenate([[0], np.cumsum(self.size)])[offsets]
        return Ragged(self.flat, np.diff(ends))

    def then(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.flat, other.flat]), np.concatenate([self.size, other.size]))


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Runs between ASCII white space (and empty ones at the ends) of each text:
    offsets, and the runs as a dictionary array."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten().dictionary_encode()
    return np.asarray(split.offsets) - split.offsets[0].as_py(), flat


class Memory:
    """Ids of at most about ``size`` names. When there are more, those of the last
    batch stay and the others are forgotten."""

    def __init__(self, size: int):
        self.size = size
        self.names, self.ids = pa.array([], pa.string()), Ragged(np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def look_up(self, names: pa.Array, encode: Callable[[list[str]], Ragged]) -> Ragged:
        """Ids of distinct ``names``; ``encode`` gives those of unknown ones."""
        at = pc.index_in(names, value_set=self.names)
        unknown = at.is_null()
        new = names.filter(unknown)
        made = encode(new.to_pylist())
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = len(self.names) + np.arange(len(new))
        every = self.ids.then(made)
        short = pc.less_equal(pc.binary_length(names), WORD)
        if len(self.names) + len(new) > self.size:
            self.names, self.ids = names.filter(short), every.take(place[short.to_numpy(zero_copy_only=False)])
        else:
            kept = short.filter(unknown)
            self.names = pa.concat_arrays([self.names, new.filter(kept)])
            if pc.all(kept).as_py() is False:
                at = np.concatenate([np.arange(len(self.ids.size)), len(self.ids.size) + np.flatnonzero(kept.to_numpy(zero_copy_only=False))])
                self.ids = every.take(at)
            else:
                self.ids = every
        return every.take(place)


class Encoder:
    """Ids of texts. Words are cut at ASCII white space and each distinct one of a
    batch is encoded once; plain words are put together from their parts, whose ids
    are remembered."""

    def __init__(self, path: str, remember: int = REMEMBER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.base = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(self.base, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.letters, self.others = Memory(remember), Memory(remember // 4)

    def __call__(self, texts: pa.Array) -> Ragged:
        offsets, words = _words(texts.fill_null(""))
        names = words.dictionary
        plain = pc.and_(pc.match_substring_regex(names, _SAFE), pc.invert(pc.match_substring(names, _SPECIAL)))
        low = pc.utf8_lower(names.filter(plain))
        for pattern, cut in _CUTS:
            low = pc.replace_substring_regex(low, pattern, cut)
        at, parts = _words(low)
        whole = self._parts(parts.dictionary).take(parts.indices.to_numpy()).merged(at)
        odd = self.others.look_up(names.filter(pc.invert(plain)), self._one_by_one)
        order = _places(plain.to_numpy(zero_copy_only=False))
        return whole.then(odd).take(order[words.indices.to_numpy()]).merged(offsets)

    def _parts(self, names: pa.Array) -> Ragged:
        """Ids of runs of letters, and of runs of other ASCII characters."""
        letters = pc.match_substring_regex(names, _LETTERS)
        known = self.letters.look_up(names.filter(letters), self._together)
        rest = self.others.look_up(names.filter(pc.invert(letters)), self._one_by_one)
        return known.then(rest).take(_places(letters.to_numpy(zero_copy_only=False)))

    def _together(self, runs: list[str]) -> Ragged:
        """Ids of runs of letters, many in one text: each ends in an end-of-word token."""
        flat, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(runs), TOGETHER):
            group = runs[lo:lo + TOGETHER]
            ids = np.array(self.tokenizer.encode(" ".join(group), add_special_tokens=False).ids, np.uint32)
            many = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(many) != len(group):
                raise ValueError("a run of letters is not one unit of the tokenizer")
            flat.append(ids)
            size.append(many)
        return Ragged(np.concatenate(flat), np.concatenate(size))

    def _one_by_one(self, names: list[str]) -> Ragged:
        found = [e.ids for e in self.tokenizer.encode_batch(names, add_special_tokens=False)]
        return Ragged(np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(x) for x in found], np.int64))


def _places(first: np.ndarray) -> np.ndarray:
    """For each entry its place when those marked ``first`` go before the others."""
    out = np.empty(len(first), np.int64)
    n = int(first.sum())
    out[first], out[~first] = np.arange(n), np.arange(n, len(first))
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and tokenizer, so that tasks share its memory."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(documents: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END, block: int = BLOCK) -> None:
    """Write ``blocks`` and ``shards`` of all documents below ``path``."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns(
        {"_same": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = ["doc_id", "_same", "_row"]   # the last one only lets equal rows spread over tasks
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        tail = np.uint32(end)
        shard = TaskContext.get().partitionId()
        out = _Blocks(shard, max(encode.base, end + 1), block)
        for batch in batches:
            for lo, hi in _stretches(batch["text"]):
                found, at = encode(batch["text"].slice(lo, hi - lo)), 0
                for doc, n in zip(batch["doc_id"].slice(lo, hi - lo).to_pylist(), found.size.tolist(), strict=True):
                    yield from out.add(doc, np.append(found.flat[at:at + n], tail))
                    at += n
        yield from out.flush()

    ranged.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")
    # one row per shard, that is per task of the write
    totals = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    totals.select("shard", F.coalesce(before, F.lit(0)).alias("first_token"), "n_tokens").write.parquet(f"{path}/shards")


def _stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of about ``STRETCH`` bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + STRETCH, "right"))
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi
        lo = hi


class _Blocks:
    """Gathers the documents of a shard into blocks."""

    def __init__(self, shard: int, base: int, size: int):
        self.shard, self.base, self.size = shard, base, size
        self.block, self.first = 0, 0
        self.docs: list[int | None] = []
        self.ids: list[np.ndarray] = []
        self.held = 0

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.held and self.held + len(ids) > self.size:
            yield from self.flush()
        if len(ids) > self.size:
            start, parts = self.first, -(-len(ids) // self.size)
            for part in range(parts):
                piece = ids[part * self.size:(part + 1) * self.size]
                yield self._row([doc], [start], [len(piece)], piece, np.arange(len(piece)) == len(piece) - 1, part, parts)
            return
        self.docs.append(doc)
        self.ids.append(ids)
        self.held += len(ids)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            sizes = np.array([len(x) for x in self.ids])
            ends = np.cumsum(sizes)
            last = np.zeros(self.held, bool)
            last[ends - 1] = True
            row = self._row(self.docs, (self.first + ends - sizes).tolist(), sizes.tolist(), np.concatenate(self.ids), last, 0, 1)
            self.docs, self.ids, self.held = [], [], 0
            yield row

    def _row(self, docs, starts, sizes, ids, last, part, parts) -> pa.RecordBatch:
        grammar = compress(ids, last, self.base).to_bytes()
        row = {"shard": pa.array([self.shard], pa.int32()), "block": pa.array([self.block], pa.int32()),
               "first": pa.array([self.first], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()),
               "part": pa.array([part], pa.int32()), "parts": pa.array([parts], pa.int32()),
               "doc_ids": pa.array([docs], pa.list_(pa.int64())), "starts": pa.array([starts], pa.list_(pa.int64())),
               "sizes": pa.array([sizes], pa.list_(pa.int64())), "grammar": pa.array([grammar], pa.binary())}
        self.block += 1
        self.first += len(ids)
        return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids
    (little-endian u32) of every document in the files at ``path``."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shards = spark.read.schema("shard int, first_token long, n_tokens long").parquet(f"{path}/shards").select("shard", "first_token")
    placed = blocks.join(bounded_broadcast(shards), "shard")
    whole = _decoded(placed.where("parts = 1")).drop("part")
    cut = _decoded(placed.where("parts > 1")).groupBy("doc_id", "start").agg(
        F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("pieces"))
    joined = F.expr("aggregate(transform(pieces, p -> p.ids), cast('' as binary), (a, b) -> concat(a, b))")
    return whole.unionByName(cut.select("doc_id", "start", "n_tokens", joined.alias("ids")))


def _decoded(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cell = lambda name: batch[name][k]  # noqa: B023, E731
                g = Grammar.from_bytes(cell("grammar").as_buffer().to_pybytes())
                sizes = np.array(cell("sizes").as_py(), np.int64)
                ids = expand(g, g.symbols).astype("<u4")
                ends = np.concatenate([[0], np.cumsum(sizes)]) * 4
                raw = ids.tobytes()
                cells = [raw[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                starts = np.array(cell("starts").as_py(), np.int64) + cell("first_token").as_py()
                yield pa.RecordBatch.from_arrays(
                    [cell("doc_ids").values, pa.array(starts), pa.array(sizes), pa.array(cells, pa.binary()),
                     pa.array(np.full(len(sizes), cell("part").as_py(), np.int32))],
                    names=["doc_id", "start", "n_tokens", "ids", "part"])

    return blocks.select("doc_ids", "starts", "sizes", "part", "first_token", "grammar").mapInArrow(run, DOCUMENTS + ", part int")


def read_ids(spark: SparkSession, path: str, doc_ids: DataFrame) -> DataFrame:
    """As :func:`read`, for the documents whose ``doc_id`` is in ``doc_ids`` only:
    finds their blocks by the lists of ids, and expands only their symbols."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    wanted = doc_ids.select(F.col("doc_id").cast("long").alias("_want")).where("_want is not null").distinct()
    held = blocks.select("shard", "block", F.posexplode("doc_ids").alias("_at", "_want")).join(wanted, "_want", "left_semi")
    at = held.groupBy("shard", "block").agg(F.sort_array(F.collect_list("_at")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                g = Grammar.from_bytes(r["grammar"])
                ids = [read_range(g, r["starts"][k] - r["first"] if r["parts"] == 1 else 0, r["starts"][k] - r["first"] + r["sizes"][k] if r["parts"] == 1 else r["sizes"][k])
                       for k in r["at"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["doc_ids"][k] for k in r["at"]], pa.int64()), pa.array([r["starts"][k] + r["first_token"] for k in r["at"]], pa.int64()),
                     pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                     pa.array([r["part"]] * len(ids), pa.int32())], names=["doc_id", "start", "n_tokens", "ids", "part"])

    shards = spark.read.schema("shard int, first_token long, n_tokens long").parquet(f"{path}/shards").select("shard", "first_token")
    found = blocks.join(at, ["shard", "block"]).join(bounded_broadcast(shards), "shard")
    rows = found.select("doc_ids", "starts", "sizes", "first", "part", "parts", "first_token", "grammar", "at").mapInArrow(run, DOCUMENTS + ", part int")
    whole = rows.groupBy("doc_id", "start").agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("pieces"))
    return whole.select("doc_id", "start", "n_tokens",
                        F.expr("aggregate(transform(pieces, p -> p.ids), cast('' as binary), (a, b) -> concat(a, b))").alias("ids"))
