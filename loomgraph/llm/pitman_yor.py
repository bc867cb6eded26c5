"""LM scoring: a hierarchical Pitman-Yor model, its Chinese-restaurant seating sampled by Gibbs.

Each token is drawn in the restaurant of the two words before it; that one's parent is the restaurant of the
one word before it, shared by all contexts that end in that word; all of these share the root, whose base is
uniform over the training vocabulary and one unknown word.

The state is how many tables serve each word in each restaurant.  A sweep draws every such number anew given
all others: t tables of c customers weigh S(c, t), with generalised Stirling numbers S, times what the t tables
pay to open and the t customers they send pay in the parent, where each finds the ones before it.  Discounts
and strengths are drawn after each sweep, and a token's probability is the average of what the kept sweeps
predict.

Restaurants are dealt to buckets by the word that their contexts end in, so a parent is with its children, and
their numbers are updated as others are drawn.  Words, that is the root, are dealt to shards: in each sweep the
buckets send the customers of each word and get back its customers and tables.  A context word with HOT tokens
or more is spread over the buckets by the word before it, and a pair of such words by the word that follows;
the dishes of a spread restaurant are kept by the words' shards like those of the root.  Each bucket's counts,
tokens and seatings are files in the shared folder, so that only numbers by word travel in a sweep.
"""

from __future__ import annotations

import math
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import _store
from loomgraph.llm._ranges import partitioned
from loomgraph.llm._text import U64, VISIBLE, mix, pieces, runs, text_bytes, tokenize

BURN_IN, SAMPLES = 2, 3
#: Strength and discount of each level (root, one word, two words) before they are first drawn.
START = ((1.0, 1.0, 1.0), (0.5, 0.75, 0.75))
#: Discounts that are drawn from.
GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))
#: Tokens to a bucket, and tokens gathered before they are dealt.
BUCKET_TOKENS = 3_000_000
UNIT_TOKENS = 1_000_000
#: Bits of a word's hash.
BITS = 56
#: Tokens from which a context is spread over the buckets.  Spreading does not change the model, so this is judged by
#: every LOOKED-th stretch of texts, by words met SEEN times there, and pairs of the TOP most frequent of them.
HOT, LOOKED, SEEN, TOP = 1_000_000, 8, 2, 64
#: Words, the most frequent ones, that tokens are sent with by number; others go by hash.
COMMON = 1 << 18
#: Buckets that tokens are dealt to at once; more are dealt to in two steps.
FAN = 2048
#: Parts in which a level's numbers are drawn; restaurants' totals are brought up to date between them.
PARTS = 2
#: Most customers of a dish whose weights come from a table.
WEIGHED = 1024
#: Share of the greatest weight that ends a list of weights, and the longest list.
LEAST, LISTED = 1e-18, 4096
END, BEGIN = U64(0x9AE16A3B2F9040), U64(0xC949D7C7509E65)


# ---- packing -------------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; bytes of equal weight stand together."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.empty(0, np.uint8)
        out += [struct.pack("<2sQ", f"{a.dtype.kind}{a.itemsize}".encode(), len(a)), np.ascontiguousarray(planes).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    (count,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(count):
        kind, n = struct.unpack_from("<2sQ", raw, at)
        dtype = np.dtype(kind.decode())
        at += struct.calcsize("<2sQ")
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).ravel())
        at += n * dtype.itemsize
    return out


def _small(values: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds the values."""
    most = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32 if most < 1 << 32 else np.uint64)


# ---- tokens --------------------------------------------------------------------------------------


def text_tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, text index) of all tokens: lower-cased words between ASCII white space, and an end per text."""
    tok = tokenize(raw, offsets, VISIBLE)
    n = len(tok.hash)
    begin = np.searchsorted(tok.doc, np.arange(tok.n_docs + 1))
    word = np.empty(n + tok.n_docs, np.uint64)
    word[np.arange(n) + tok.doc], word[begin[1:] + np.arange(tok.n_docs)] = tok.hash >> U64(64 - BITS), END
    return word, np.repeat(np.arange(tok.n_docs), np.diff(begin) + 1)


def _before(word: np.ndarray, doc: np.ndarray, by: int, none: int) -> np.ndarray:
    """What stands so many tokens before each in its text, or `none`."""
    out = np.full(len(word), none, word.dtype)
    out[by:] = np.where(doc[by:] == doc[:-by], word[:-by], none) if len(word) > by else out[by:]
    return out


def _rank(columns: tuple[np.ndarray, ...], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(stable order of rows by these columns of numbers below `most`, whether each row in order differs from the one before)."""
    bits = max(1, int(most).bit_length())
    if bits * len(columns) <= 64:
        key = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            key <<= U64(bits)
            key |= c.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        return order, fresh
    order = np.lexsort(columns[::-1])
    fresh = np.zeros(len(order), dtype=bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[order][1:] != c[order][:-1]
    return order, fresh


def _code(*parts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        total = mix(total * U64(0x9FB21C651E98DF25) + p)
    return total


def _split(words: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in order as numbers of common ones, which are in order too, and the others' hashes; both as differences."""
    at = np.minimum(np.searchsorted(common, words), max(0, len(common) - 1))
    known = common[at] == words if len(common) else np.zeros(len(words), dtype=bool)
    return _small(np.diff(at[known], prepend=0)), np.diff(words[~known], prepend=U64(0))


def _joined(known: np.ndarray, other: np.ndarray, common: np.ndarray) -> np.ndarray:
    return np.sort(np.concatenate([common[np.cumsum(known, dtype=np.int64)], np.cumsum(other, dtype=np.uint64)]))


class Route:
    """Which bucket a token belongs to, and the numbers of common words: BEGIN comes after them, then the other words of a block."""

    def __init__(self, buckets: int, words: np.ndarray, pairs: np.ndarray, common: np.ndarray) -> None:
        self.buckets, self.words, self.pairs = buckets, words, pairs
        self.common = np.append(common[common != BEGIN], BEGIN)
        self.begin = len(self.common) - 1
        self.in_order = np.sort(self.common)
        self.mask = U64((1 << max(8, 2 + (len(self.common)).bit_length())) - 1)
        self.slot = np.zeros(int(self.mask) + 1, np.int32)
        self.slot[(self.common[::-1] & self.mask).astype(np.int64)] = np.arange(len(self.common), dtype=np.int32)[::-1]

    def numbers(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word, the words that are not common)."""
        at = self.slot[(word & self.mask).astype(np.int64)]
        rare = np.flatnonzero(self.common[at] != word)
        other, number = np.unique(word[rare], return_inverse=True)
        at[rare] = number + len(self.common)
        return at, other

    def bucket(self, words: np.ndarray, p1: np.ndarray, p2: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The bucket of each token, of numbers among `words`."""
        out = (_code(words) % U64(self.buckets)).astype(np.int32)[p1]
        spread = np.flatnonzero(np.isin(words, self.words)[p1])
        if len(spread):
            code = _code(words[p1[spread]], words[p2[spread]])
            again = np.flatnonzero(np.isin(code, self.pairs))
            code[again] = mix(code[again] + words[w[spread[again]]])
            out[spread] = (code % U64(self.buckets)).astype(np.int32)
        return out


@dataclass
class Block:
    """Some tokens of a unit in order of their texts: numbers of the word before, the word, and the word before that."""

    rare: np.ndarray
    p1: np.ndarray
    w: np.ndarray
    p2: np.ndarray
    doc: np.ndarray
    held: np.ndarray

    def pack(self) -> bytes:
        kinds, at = np.unique(self.p1, return_inverse=True)
        return _pack(np.diff(self.rare, prepend=U64(0)), *map(_small, (kinds, at, self.w, self.p2, np.diff(self.doc, prepend=0))), np.packbits(self.held))

    @staticmethod
    def of(block: bytes) -> Block:
        rare, kinds, at, w, p2, doc, held = _unpack(block)
        return Block(np.cumsum(rare, dtype=np.uint64), kinds.astype(np.int32)[at], w.astype(np.int32), p2.astype(np.int32), np.cumsum(doc, dtype=np.int64).astype(np.int32), np.unpackbits(held).astype(bool))

    def deal(self, route: Route, coarse: int | None = None) -> Iterator[tuple[int, Block]]:
        """The parts of it that go to each bucket, or to each of so many groups of buckets."""
        bucket = route.bucket(np.concatenate([route.common, self.rare]), self.p1, self.p2, self.w)
        if coarse:
            bucket %= coarse
        order = np.argsort(bucket.astype(np.uint16) if route.buckets < 1 << 16 else bucket, kind="stable")
        bound = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        known = len(route.common)
        local = np.arange(known + len(self.rare), dtype=np.int32)
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            at = order[a:b]
            p1, w, p2 = self.p1[at], self.w[at], self.p2[at]
            used = np.zeros(known + len(self.rare), dtype=bool)
            used[p1] = used[w] = used[p2] = True
            rare = np.flatnonzero(used[known:])
            local[known + rare] = known + np.arange(len(rare), dtype=np.int32)
            yield int(bucket[at[0]]), Block(self.rare[rare], local[p1], local[w], local[p2], self.doc[at], self.held)


def _block(word: np.ndarray, doc: np.ndarray, held: np.ndarray, route: Route) -> Block:
    """All tokens of a unit; `held` says by text which are not learnt from."""
    w, rare = route.numbers(word)
    return Block(rare, _before(w, doc, 1, route.begin), w, _before(w, doc, 2, route.begin), doc.astype(np.int32), held)


def _units(batches: Iterator[pa.RecordBatch], unit_tokens: int) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(name, doc_ids, words, text index, held out) of the texts of a task, some at a time."""
    task, number, parts, held, texts = TaskContext.get().partitionId(), 0, [], 0, 0

    def made():
        word, doc = (np.concatenate([p[i] for p in parts]) for i in range(2))
        return f"{task}-{number}", pa.concat_arrays([p[2] for p in parts]), word, doc, np.concatenate([p[3] for p in parts])

    for batch in pieces(batches, "text", 2 << 20):
        word, doc = text_tokens(*text_bytes(batch.column("text")))
        parts.append((word, doc + texts, batch.column("doc_id"), batch.column("held").to_numpy(zero_copy_only=False)))
        held += len(word)
        texts += batch.num_rows
        if held >= unit_tokens:
            yield made()
            number, parts, held, texts = number + 1, [], 0, 0
    if parts:
        yield made()


def _common_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every LOOKED-th stretch the tokens, the words met SEEN times, with BEGIN once a text, and pairs of the TOP ones among them."""
    for i, batch in enumerate(pieces(batches, "text", 2 << 20)):
        if i % LOOKED:
            continue
        word, doc = text_tokens(*text_bytes(batch.column("text")))
        words, at, count = np.unique(np.append(word, np.full(batch.num_rows, BEGIN)), return_inverse=True, return_counts=True)
        at = at[: len(word)]
        some = np.flatnonzero(count >= SEEN)
        top = np.full(len(words), TOP, np.int64)
        best = some[np.argsort(-count[some], kind="stable")[:TOP]]
        top[best] = np.arange(len(best))
        begin = int(np.searchsorted(words, BEGIN))
        p1, p2 = top[_before(at, doc, 1, begin)], top[_before(at, doc, 2, begin)]
        both = (p1 < TOP) & (p2 < TOP)
        pair = np.bincount(p1[both] * TOP + p2[both], minlength=1)
        met = np.flatnonzero(pair >= SEEN)
        code = _code(words[best[met // TOP]], words[best[met % TOP]]) if len(met) else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([[0], np.ones(len(some)), np.full(len(met), 2)]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(1, np.uint64), words[some], code]).view(np.int64)),
                pa.array(np.concatenate([[len(word)], count[some], pair[met]]).astype(np.int64) * LOOKED),
            ],
            names=["words", "code", "n"],
        )


_DEALT = ["bucket", "unit", "ids", "block"]


def _dealt(bucket: int, unit: str, ids: pa.Array, block: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([unit]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([block], pa.binary())], names=_DEALT
    )


def _deal_rows(route, unit_tokens: int, coarse: int | None):
    """The tokens of each unit by bucket, and (bucket -1 - k) its doc_ids with the number of tokens of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to: Route = route.value
        for unit, ids, word, doc, held in _units(batches, unit_tokens):
            yield _dealt(-1 - int(_code(np.frombuffer(unit.encode().ljust(16)[-16:], np.uint64))[0] % U64(to.buckets)), unit, ids, _pack(np.bincount(doc, minlength=len(ids)).astype(np.uint32)))
            for bucket, part in _block(word, doc, held, to).deal(to, coarse):
                yield _dealt(bucket, unit, ids[:0], part.pack())

    return run


def _again_rows(route):
    """Blocks of a coarse bucket dealt to its fine ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                row = batch.slice(i, 1)
                if bucket < 0:
                    yield row
                    continue
                unit, ids = row.column("unit")[0].as_py(), row.column("ids")[0].values
                for fine, part in Block.of(row.column("block")[0].as_py()).deal(route.value):
                    yield _dealt(fine, unit, ids, part.pack())

    return run


# ---- files ---------------------------------------------------------------------------------------


def _write(url: str, data: bytes) -> None:
    """A file that is there as a whole or not at all."""
    fs, path = pafs.FileSystem.from_uri(url)
    part = f"{path}.{os.getpid()}-{os.urandom(4).hex()}.part"
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    try:
        fs.move(part, path)
    except OSError:  # some stores do not replace a file: an earlier attempt wrote the same
        if fs.get_file_info(path).type != pafs.FileType.File:
            raise
        fs.delete_file(part)


def _read(url: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(url)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


# ---- restaurants ---------------------------------------------------------------------------------


@dataclass
class Level:
    """What all tasks need to know: strengths and discounts, sums of the root, and totals of spread restaurants."""

    strength: tuple[float, ...]
    discount: tuple[float, ...]
    tokens: int = 0
    types: int = 0
    customers0: int = 0
    tables0: int = 0
    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    customers1: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    tables1: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    customers2: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    tables2: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @property
    def base(self) -> float:
        return 1 / (self.types + 1)

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of words with these customers and tables in the root."""
        s, d = self.strength[0], self.discount[0]
        return (customers - d * tables + (s + d * self.tables0) * self.base) / (s + self.customers0)


def predict(strength: float, discount: float, total: np.ndarray, all_tables: np.ndarray, customers: np.ndarray, tables: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Probability of dishes in their restaurants, given that in the parent."""
    return (customers - discount * tables + (strength + discount * all_tables) * above) / (strength + total)


def _stirling(discount: float, most: int = WEIGHED) -> np.ndarray:
    """log S(c, t) of c customers at t tables, for both up to `most`."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for n in range(1, most):
        stay = n - discount * np.arange(1, n + 1)
        out[n + 1, 1 : n + 1] = np.logaddexp(out[n, :n], np.log(stay) + out[n, 1 : n + 1])
        out[n + 1, n + 1] = 0.0
    return out


#: Tables of 8 MB: a worker keeps those of one sweep, the driver those of GRID.
stirling, _grid_table = lru_cache(maxsize=3)(_stirling), lru_cache(maxsize=len(GRID))(_stirling)

_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def _saddle(customers: int | np.ndarray, discount: float, t: np.ndarray) -> np.ndarray:
    """log S(customers, t) up to a common summand, by the saddle point of (1 - (1 - z)**d)**t at the power `customers`."""
    d = discount
    v = np.minimum(np.log(t * d / customers) / (1 - d), -1e-9)  # log of y = 1 - z
    for _ in range(12):
        y, part = np.exp(v), -np.expm1(d * v)
        miss = np.log(t * d) + np.log1p(-y) + (d - 1) * v - np.log(part) - np.log(customers)
        v = np.minimum(v - miss / (d - 1 - y / (1 - y) + d * (1 - part) / part), -1e-9)
    y, part = np.exp(v), -np.expm1(d * v)
    pull = t * d * (1 - y) * y ** (d - 1) / part
    width = pull * (1 + (1 - y) * ((1 - d) / y - d * y ** (d - 1) / part))
    return t * np.log(part / d) - customers * np.log1p(-y) - 0.5 * np.log(width) - _log_gamma(t + 1)


@lru_cache(maxsize=len(GRID) + 3)
def _scaled(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """What the table's last row gives for more customers.

    Up to a discount of 1/2: what the saddle point misses for each number of tables.  Beyond: (log t, log of how far
    S(W, t + 1) / S(W, t) * discount * t falls below 1, as a log).  A worker keeps these for all of GRID, a few KB each; the
    table itself is not kept, so that those of a sweep are.
    """
    log_s = _stirling(discount)[WEIGHED]
    if discount <= 0.5:
        t = np.arange(1, WEIGHED // 2)
        return t, log_s[t] - _saddle(WEIGHED, discount, t.astype(float))
    t = np.arange(2, WEIGHED // 2)
    return np.log(t), np.log(np.maximum(-(log_s[t + 1] - log_s[t] + np.log(discount * t)), 1e-300))


#: Share of tables among customers from which weights scale with that share.
SHARE = 0.05


def _steps(customers: int, discount: float, t: np.ndarray) -> np.ndarray:
    """log S(customers, t + 1) - log S(customers, t).

    With a discount up to 1/2 the saddle point serves, and what it misses depends on t.  Beyond it the fall of a
    step is c**-d * G(t / c**d) for c customers while tables are few among them, and a function of t / c else.
    """
    x, fall = _scaled(discount)
    if discount <= 0.5:
        both = np.concatenate([t, t[-1:] + 1]).astype(float)
        if len(t) and t[-1] - t[0] == len(t) - 1:  # neighbours: each value once
            found = _saddle(customers, discount, both) + fall[np.minimum(both.astype(np.int64), len(fall)) - 1]
            return np.diff(found)
        here, there = (_saddle(customers, discount, v.astype(float)) + fall[np.minimum(v, len(fall)) - 1] for v in (t, t + 1))
        return there - here
    return -_fallen(customers, discount, t, x, fall) - np.log(discount * t)


#: Nodes that a sum of steps is taken at.
NODES = 128


def _logs(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """log S(customers, tables) of dishes of more than WEIGHED customers: of one table exactly, of more by the sum of `_steps`.

    Where tables are nearly as many as customers, by the pairs that sit together; where the discount is beyond 1/2 and
    tables are more than half the customers, by the saddle point.  For 3000 customers within 1 of the true logs, from a
    discount of 0.9 on within 5.
    """
    c, t = customers.astype(float), tables.astype(float)
    rest = c - t
    near = rest * rest <= 0.05 * c
    t = np.where(near, np.maximum(1.0, np.floor(c / 4)), t)  # any number that can be worked out
    paired = rest * np.log(c * (c - 1) / 2 * (1 - discount)) - _log_gamma(rest + 1)
    return np.where(near, paired, _logs_below(c, t, discount))


def _logs_below(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    one = _log_gamma(c - discount) - math.lgamma(1 - discount)
    x, fall = _scaled(discount)
    if discount <= 0.5:
        found = [_saddle(c, discount, v) + fall[np.minimum(v.astype(np.int64), len(fall)) - 1] for v in (np.ones_like(t), t)]
        return one + found[1] - found[0]
    few = np.minimum(t, c / 2)
    at = np.exp(np.linspace(0.0, 1.0, NODES)[None, :] * np.log(np.maximum(few - 1, 1))[:, None])
    miss = _fallen(c[:, None], discount, at, x, fall)
    # the sum over whole numbers as the integral, over logs, and half of both ends
    area = (0.5 * (miss[:, 1:] * at[:, 1:] + miss[:, :-1] * at[:, :-1]) * np.diff(np.log(at), axis=1)).sum(axis=1) + 0.5 * (miss[:, 0] + miss[:, -1])
    low = one - (t - 1) * math.log(discount) - _log_gamma(t) - np.where(t > 1, area, 0.0)
    return np.where(t > c / 2, _saddle(c, discount, t) + _log_gamma(c + 1) - 0.5 * math.log(2 * math.pi), low)


def _fallen(customers, discount: float, t: np.ndarray, x: np.ndarray, fall: np.ndarray) -> np.ndarray:
    """How far a step falls below that of ever more customers, for a discount beyond 1/2."""
    many = np.log(customers / WEIGHED)
    few = t < SHARE * customers
    at = np.log(t) - np.where(few, discount, 1.0) * many
    slope = (fall[-1] - fall[-33]) / (x[-1] - x[-33])
    below = (fall[8] - fall[0]) / (x[8] - x[0])
    level = np.where(at > x[-1], fall[-1] + slope * (at - x[-1]), np.where(at < x[0], fall[0] + below * (at - x[0]), np.interp(at, x, fall)))
    return np.exp(level - np.where(few, discount * many, 0.0))


@dataclass
class Rise:
    """What the k-th new table of a dish weighs: free + step * k, times what its customer pays in the parent.

    That is (own + k - less) / (total + k), where `less` is taken off from the second on for a dish that is new
    to the parent, as the first has opened a table there; with `grow` 0 the parent does not change.
    """

    free: np.ndarray
    step: float
    own: np.ndarray
    less: np.ndarray
    total: np.ndarray
    grow: float = 1.0

    def second(self, rows) -> np.ndarray:
        """What a second table weighs."""
        return (self.free[rows] + self.step) * (self.own[rows] + self.grow - self.less[rows]) / (self.total[rows] + self.grow)

    def logs(self, rows, k: np.ndarray) -> np.ndarray:
        later = (k > 0).astype(float)
        own = self.own[rows, None] + self.grow * k - self.less[rows, None] * later
        return np.log((self.free[rows, None] + self.step * k) * own / (self.total[rows, None] + self.grow * k))


def _draw(customers: int, rise: Rise, i: int, discount: float, rng: np.random.Generator) -> int:
    """Tables of a dish of many customers.

    Numbers are listed from one on until what is beyond weighs nothing; where that takes a long list, only those
    around the likeliest number, which steps of falling weight lead to.
    """
    one = np.array([i])
    gain = lambda t: _steps(customers, discount, t) + rise.logs(one, t)[0]
    first, most = 1, 64
    while True:
        t = np.arange(1, min(most, customers))
        weight = np.concatenate([[0.0], np.cumsum(gain(t))])
        weight = np.exp(weight - weight.max())
        if weight[-1] < LEAST or most >= customers:
            break
        most *= 4
        if most > LISTED:
            first, high = 1, customers - 1
            while high - first > 1:
                middle = (first + high) // 2
                first, high = (middle, high) if gain(np.array([middle]))[0] > 0 else (first, middle)
            mode, wide = first, 256
            ends = lambda: (max(1, mode - wide), min(customers - 1, mode + wide))
            while wide < customers and any(abs(float(gain(np.array([e]))[0])) * wide < 90 for e in ends() if 1 < e < customers - 1):
                wide *= 2
            first, last = ends()
            weight = np.concatenate([[0.0], np.cumsum(gain(np.arange(first, last)))])
            weight = np.exp(weight - weight.max())
            break
    total = np.cumsum(weight)
    return first + int((total <= rng.random() * total[-1]).sum())


def reseat(customers: np.ndarray, rise: Rise, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables drawn anew from the conditional given all other dishes.

    t tables weigh S(customers, t) times what each weighs by `rise`.  S comes from a table up to WEIGHED customers
    and from how its last row scales beyond.
    """
    out = np.minimum(customers, 1).astype(np.int64)
    two = np.flatnonzero(customers == 2)
    odds = rise.second(two) / (1 - discount)
    out[two] += rng.random(len(two)) * (1 + odds) < odds
    order = np.flatnonzero((customers > 2) & (customers <= WEIGHED))
    order = order[np.argsort(customers[order], kind="stable")]
    log_s = stirling(discount)
    lo = 0
    while lo < len(order):
        width = int(customers[order[lo]])
        hi = lo + max(1, (1 << 18) // (width + width // 8))
        some = order[lo:hi]
        some = some[customers[some] <= width + width // 8]
        width = int(customers[some[-1]])
        weight = np.cumsum(rise.logs(some, np.arange(width)), axis=1) + log_s[customers[some], 1 : width + 1]
        weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        out[some] = 1 + (weight <= (rng.random(len(some)) * weight[:, -1])[:, None]).sum(axis=1)
        lo += len(some)
    many = np.flatnonzero(customers > WEIGHED)
    out[many] = [_draw(int(customers[i]), rise, i, discount, rng) for i in many.tolist()]
    return out


def without(customers: np.ndarray, tables: np.ndarray, gone: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes after so many of their customers got up: one sat alone with a chance of S(c - 1, t - 1) / S(c, t).

    Beyond WEIGHED customers tables go as the power of customers that they grow with.
    """
    out = np.minimum(tables, customers - gone)
    many = np.flatnonzero(customers > WEIGHED)
    left = customers[many] - gone[many]
    out[many] = np.maximum(np.minimum(left, 1), np.minimum(left, np.round(tables[many] * (left / customers[many]) ** discount).astype(np.int64)))
    log_s = stirling(discount)
    some = np.flatnonzero((customers <= WEIGHED) & (gone > 0) & (tables > 0))
    c, t, more = customers[some], tables[some].copy(), gone[some]
    active, step = np.arange(len(some)), 0
    while len(active):
        now, held = c[active] - step, t[active]
        alone = rng.random(len(active)) < np.exp(log_s[now - 1, held - 1] - log_s[now, held])
        t[active] = held - np.where(now == 1, 1, alone)
        step += 1
        active = active[more[active] > step]
    out[some] = t
    return out


def _parted(rows: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    part = rng.integers(0, PARTS, len(rows))
    return [rows[part == p] for p in range(PARTS)]


def _sum(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, n).round().astype(np.int64)


class Bucket:
    """The restaurants of a bucket.

    Contexts of one word are in order, and so are their dishes (`in1`: the context of a dish, `dish_word`) and their
    restaurants of two words; rows are the dishes of those (`in2`: the restaurant of a row, `to1`: its dish one level up).
    """

    def __init__(self, words: np.ndarray, context: np.ndarray, dishes: np.ndarray, dish_word: np.ndarray, pairs: np.ndarray, rows: np.ndarray, place: np.ndarray, customers: np.ndarray, hot2: tuple[np.ndarray, np.ndarray]) -> None:
        self.parts = (context, dishes, dish_word, pairs, rows, place, customers, *hot2)
        self.words, self.context, self.dish_word, self.customers = words, context, dish_word, customers
        self.n_pairs = len(rows)
        self.in1 = np.repeat(np.arange(len(context)), dishes)
        self.in2 = np.repeat(np.arange(len(rows)), rows)
        first = np.repeat(np.cumsum(dishes) - dishes, pairs)
        self.to1 = np.repeat(first, rows) + place
        self.hot2 = np.full(len(rows), -1)
        self.hot2[hot2[0]] = hot2[1]
        mask = np.zeros(len(words), dtype=bool)
        mask[dish_word] = True
        self.served = np.flatnonzero(mask)
        self.where = (np.cumsum(mask) - 1)[dish_word]

    @staticmethod
    def of(words: np.ndarray, columns: list[np.ndarray], trained: np.ndarray, spread_pairs: np.ndarray) -> tuple[Bucket, np.ndarray]:
        """(the bucket of these tokens, of numbers among `words`, the row of each token).

        `columns`: the word before, the word, and the word before that; the list is emptied, so that they go early.
        """
        p1, w, p2 = columns
        columns.clear()
        order, fresh = _rank((p1, p2, w), len(words))
        row = np.empty(len(order), np.int32)
        row[order] = np.cumsum(fresh, dtype=np.int32) - 1
        some = order[fresh]
        del order, fresh
        customers = _sum(row, trained, len(some))
        p1, w, p2 = p1[some], w[some], p2[some]
        order, fresh = _rank((p1, w), len(words))
        dish = np.empty(len(order), np.int64)
        dish[order] = np.cumsum(fresh) - 1
        one = order[fresh]
        begin = runs(p1)
        dishes = np.bincount(np.searchsorted(begin, one, side="right") - 1, minlength=len(begin))
        new = np.ones(len(p1), dtype=bool)
        new[1:] = (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
        house = np.flatnonzero(new)
        pairs = np.diff(np.append(np.searchsorted(house, begin), len(house)))
        place = dish - np.repeat(np.cumsum(dishes) - dishes, np.diff(np.append(begin, len(p1))))
        hot = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(spread_pairs):
            code = _code(words[p1[house]], words[p2[house]])
            at = np.minimum(np.searchsorted(spread_pairs, code), len(spread_pairs) - 1)
            same = np.flatnonzero(spread_pairs[at] == code)
            hot = same, at[same]
        rows = np.diff(np.append(house, len(p1)))
        return Bucket(words, p1[begin].astype(np.int64), dishes, w[one].astype(np.int64), pairs, rows, place, customers, hot), row

    def static(self, common: np.ndarray) -> bytes:
        context, *rest = self.parts
        return _pack(*_split(self.words, common), _small(np.diff(context, prepend=0)), *map(_small, rest))

    @staticmethod
    def load(block: bytes, common: np.ndarray) -> Bucket:
        known, other, context, *rest = _unpack(block)
        rest = [a.astype(np.int64) for a in rest]
        return Bucket(_joined(known, other, common), np.cumsum(context, dtype=np.int64), *rest[:-2], (rest[-2], rest[-1]))

    def spread(self, level: Level) -> None:
        """Find the restaurants that other buckets share."""
        hot = self.words[self.context]
        at = np.minimum(np.searchsorted(level.words, hot), max(0, len(level.words) - 1))
        self.hot1 = np.where(level.words[at] == hot, at, -1) if len(level.words) else np.full(len(hot), -1)
        shared = self.hot1[self.in1] >= 0
        dishes = np.flatnonzero(shared)
        #: Dishes of spread restaurants in order of word, as they are sent to the words' shards.
        self.shared = dishes[np.lexsort((self.hot1[self.in1[dishes]], self.where[dishes]))]
        self.own = np.flatnonzero(~shared)

    # seatings: tables2 by row; customers1 and tables1 by dish (all customers, those of other buckets included)

    def begin(self) -> None:
        self.tables2 = np.minimum(self.customers, 1)
        self.customers1 = _sum(self.to1, self.tables2, len(self.dish_word))
        self.tables1 = np.minimum(self.customers1, 1)

    def sent(self) -> tuple[np.ndarray, np.ndarray]:
        """(customers that this bucket's own dishes send to the root by word, customers here of each shared dish)."""
        here = _sum(self.to1, self.tables2, len(self.dish_word)) if len(self.shared) else self.customers1
        return _sum(self.where[self.own], self.tables1[self.own], len(self.served)), here[self.shared]

    def totals(self, level: Level) -> tuple[np.ndarray, ...]:
        """Customers and tables of the restaurants of one and of two words."""
        c2, t2 = (_sum(self.in2, v, self.n_pairs) for v in (self.customers, self.tables2))
        c1, t1 = (_sum(self.in1, v, len(self.context)) for v in (self.customers1, self.tables1))
        for own, of, hot in ((c1, level.customers1, self.hot1), (t1, level.tables1, self.hot1), (c2, level.customers2, self.hot2), (t2, level.tables2, self.hot2)):
            some = np.flatnonzero(hot >= 0)
            own[some] = np.maximum(of[hot[some]], own[some])
        return c1, t1, c2, t2

    def sweep(self, level: Level, c0: np.ndarray, t0: np.ndarray, rng: np.random.Generator) -> None:
        """Draw all tables anew, first those of two words; c0 and t0 are the root's customers and tables by word."""
        (s0, s1, s2), (d0, d1, d2) = level.strength, level.discount
        all1, tab1, _, tab2 = self.totals(level)
        c0, all0 = c0.copy(), level.customers0
        root = level.root(c0, t0)[self.where]
        for some in _parted(np.flatnonzero(self.customers > 1), rng):
            old, dish, house = self.tables2[some], self.to1[some], self.in2[some]
            context = self.in1[dish]
            others = self.customers1[dish] - old
            kept = without(self.customers1[dish], self.tables1[dish], old, d1, rng)
            own = others - d1 * kept + (s1 + d1 * (tab1[context] - self.tables1[dish] + kept)) * root[dish]
            rise = Rise(s2 + d2 * (tab2[house] - old), d2, own, np.where(others == 0, d1, 0.0), s1 + all1[context] - old)
            new = reseat(self.customers[some], rise, d2, rng)
            more = new - old
            self.tables2[some] = new
            self.customers1 += _sum(dish, more, len(self.customers1))
            all1 += _sum(context, more, len(all1))
            tab2 += _sum(house, more, len(tab2))
            short = np.maximum(np.minimum(self.customers1, 1), np.minimum(self.tables1, self.customers1))
            tab1 += _sum(self.in1, short - self.tables1, len(tab1))
            self.tables1 = short
        own_dishes = self.own[self.customers1[self.own] > 1]
        for some in _parted(own_dishes, rng):
            old, word, context = self.tables1[some], self.where[some], self.in1[some]
            others = np.maximum(c0[word] - old, 0)
            kept = without(others + old, np.clip(t0[word], 1, others + old), old, d0, rng)
            own = others - d0 * kept + (s0 + d0 * (level.tables0 - t0[word] + kept)) * level.base
            rise = Rise(s1 + d1 * (tab1[context] - old), d1, own, np.where(others == 0, d0, 0.0), s0 + np.maximum(all0 - old, 0))
            new = reseat(self.customers1[some], rise, d1, rng)
            more = new - old
            self.tables1[some] = new
            tab1 += _sum(context, more, len(tab1))
            c0 += _sum(word, more, len(c0))
            all0 += int(more.sum())

    def probabilities(self, level: Level, c0: np.ndarray, t0: np.ndarray) -> np.ndarray:
        """Of the word of each row after its context."""
        all1, tab1, all2, tab2 = self.totals(level)
        one = predict(level.strength[1], level.discount[1], all1[self.in1], tab1[self.in1], self.customers1, self.tables1, level.root(c0, t0)[self.where])
        return predict(level.strength[2], level.discount[2], all2[self.in2], tab2[self.in2], self.customers, self.tables2, one[self.to1])

    def seats(self) -> bytes:
        return _pack(*map(_small, (self.tables2, self.customers1, self.tables1)))

    def sit(self, block: bytes) -> None:
        self.tables2, self.customers1, self.tables1 = (a.astype(np.int64) for a in _unpack(block))

    def told(self, customers: np.ndarray, tables: np.ndarray) -> None:
        """Take over customers and tables of shared dishes."""
        self.customers1[self.shared], self.tables1[self.shared] = customers, tables


class Shard:
    """The root's customers and tables of some words, and the dishes that they are in spread restaurants."""

    def __init__(self, first: list[tuple[int, bytes]], common: np.ndarray) -> None:
        """From each bucket's first message."""
        parts = [(b, _unpack(block)) for b, block in first]
        words = [_joined(p[0], p[1], common) for _, p in parts]
        parts = [(b, p[1:]) for b, p in parts]
        self.words = np.unique(np.concatenate([*words, np.empty(0, np.uint64)]))
        self.at = {b: np.searchsorted(self.words, w) for (b, _), w in zip(parts, words, strict=True)}
        code = {b: self.at[b][p[3].astype(np.int64)] << 32 | p[4].astype(np.int64) for b, p in parts}
        found = np.unique(np.concatenate([*code.values(), np.empty(0, np.int64)]))
        self.dish_word, self.hot = found >> 32, found & 0xFFFFFFFF
        self.dish_at = {b: np.searchsorted(found, c) for b, c in code.items()}
        self.count = self._added(self.at, {b: p[1] for b, p in parts}, len(self.words))
        self.tables0 = self.tables1 = None
        self.n = len(self.words)

    def static(self) -> bytes:
        """Where each bucket's words and dishes are: all that later sweeps need."""
        names = np.array(sorted(self.at), np.int64)
        told = [a for b in names.tolist() for a in (np.diff(self.at[b], prepend=0), self.dish_at[b])]
        return _pack(names, np.array([self.n]), *map(_small, (self.dish_word, self.hot, *told)))

    @staticmethod
    def load(block: bytes) -> Shard:
        s = Shard.__new__(Shard)
        names, n, dish_word, hot, *told = _unpack(block)
        s.n, s.dish_word, s.hot = int(n[0]), dish_word.astype(np.int64), hot.astype(np.int64)
        s.at = {b: np.cumsum(told[2 * i], dtype=np.int64) for i, b in enumerate(names.tolist())}
        s.dish_at = {b: told[2 * i + 1].astype(np.int64) for i, b in enumerate(names.tolist())}
        return s

    @staticmethod
    def _added(at: dict, values: dict, n: int) -> np.ndarray:
        total = np.zeros(n, np.int64)
        for b, v in values.items():
            total[at[b]] += v  # no bucket names a word or dish twice
        return total

    def gather(self, messages: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(customers of the root by word but for those of spread restaurants, customers of shared dishes)."""
        own = self._added(self.at, {b: m[0] for b, m in messages.items()}, self.n)
        return own, self._added(self.dish_at, {b: m[1] for b, m in messages.items()}, len(self.hot))

    def draw(self, level: Level, messages: dict, rng: np.random.Generator | None) -> None:
        """Draw the tables of shared dishes and then of the root anew; without `rng` each dish has one."""
        own, self.customers1 = self.gather(messages)
        if rng is None:
            self.tables1 = np.minimum(self.customers1, 1)
            self.customers0 = own + _sum(self.dish_word, self.tables1, len(own))
            self.tables0 = np.minimum(self.customers0, 1)
            return
        (s0, s1, _), (d0, d1, _) = level.strength, level.discount
        old = np.minimum(self.tables1, self.customers1)
        c0 = own + _sum(self.dish_word, old, len(own))
        if len(old):
            word, t0 = self.dish_word, np.minimum(self.tables0, c0)
            others = c0[word] - old
            kept = without(c0[word], t0[word], old, d0, rng)
            above = others - d0 * kept + (s0 + d0 * (level.tables0 - t0[word] + kept)) * level.base
            rise = Rise(np.maximum(s1 + d1 * (level.tables1[self.hot] - old), s1), d1, above, np.where(others == 0, d0, 0.0), s0 + np.maximum(level.customers0 - old, 0))
            self.tables1 = reseat(self.customers1, rise, d1, rng)
            c0 = own + _sum(word, self.tables1, len(own))
        self.customers0, same = c0, np.zeros(len(c0))
        rise = Rise(np.maximum(s0 + d0 * (level.tables0 - self.tables0), s0), d0, same + level.base, same, same + 1.0, 0.0)
        self.tables0 = reseat(c0, rise, d0, rng)

    def reply(self, bucket: int, first: bool) -> tuple[np.ndarray, ...]:
        at, dish = self.at[bucket], self.dish_at[bucket]
        told = self.customers0[at], self.tables0[at], self.customers1[dish], self.tables1[dish]
        return (*told, self.count[at]) if first else told


# ---- what is learnt about strengths and discounts --------------------------------------------------

_SUMS, _CUSTOMERS1, _TABLES1, _CUSTOMERS2, _TABLES2 = 0, 1, 2, 3, 4
_HELD, _DISH, _WAIT, _LARGE = 10, 20, 30, 40


def _counted(kind: int, values: np.ndarray) -> list[tuple[int, int, float]]:
    found, n = np.unique(values, return_counts=True)
    return [(kind, int(v), float(c)) for v, c in zip(found.tolist(), n.tolist(), strict=True)]


def _by_key(kind: int, keys: np.ndarray, values: np.ndarray) -> list[tuple[int, int, float]]:
    return [(kind, int(k), float(v)) for k, v in zip(keys.tolist(), values.tolist(), strict=True) if v]


def _house_stats(level: int, customers: np.ndarray, tables: np.ndarray, strength: float, rng: np.random.Generator) -> list[tuple[int, int, float]]:
    """Tables of restaurants, and the logs of their waiting shares (drawn from Beta distributions)."""
    some = customers > 1
    wait = np.log(np.maximum(rng.beta(strength + 1, customers[some] - 1), 1e-300)).sum() if some.any() else 0.0
    return [*_counted(_HELD + level, tables[tables > 1]), (_WAIT + level, 0, float(wait))]


def _dish_stats(level: int, customers: np.ndarray, tables: np.ndarray) -> list[tuple[int, int, float]]:
    """Dishes by customers and tables; of those of more than WEIGHED customers the sums of logs for each discount of GRID."""
    some, large = (customers > 1) & (customers <= WEIGHED), customers > WEIGHED
    sums = [(_LARGE + level, i, float(_logs(customers[large], tables[large], d).sum())) for i, d in enumerate(GRID)] if large.any() else []
    return [*_counted(_DISH + level, customers[some] << 20 | tables[some]), *sums]


def _resample(strength: float, houses: dict[int, float], dishes: dict[int, float], wait: float, rng: np.random.Generator, large: dict[int, float] | None = None) -> tuple[float, float]:
    """(strength, discount) drawn given the tables: the discount on GRID, the strength by auxiliary variables; priors are flat and Gamma(1, 1).

    `large` has, by place in GRID, what dishes of more than WEIGHED customers weigh.
    """
    held = np.array(sorted(houses), np.int64)
    n = np.array([houses[int(h)] for h in held])
    c, t = (np.array([k >> 20 for k in dishes], np.int64), np.array([k & ((1 << 20) - 1) for k in dishes], np.int64))
    m = np.array(list(dishes.values()))
    logs = []
    for i, d in enumerate(GRID):
        opened = (held - 1) * math.log(d) + _log_gamma(held + strength / d) - math.lgamma(1 + strength / d) if len(held) else np.zeros(0)
        logs.append(float((n * opened).sum() + (m * _grid_table(d)[c, t]).sum()) + (large or {}).get(i, 0.0))
    logs = np.array(logs)
    weight = np.exp(logs - logs.max())
    discount = GRID[int(rng.choice(len(GRID), p=weight / weight.sum()))]
    drawn = 0.0
    edges = np.concatenate([[1], held])
    for k in range(len(held)):  # so many restaurants have an i-th table, for i from one number of tables to the next
        many = int(n[k:].sum())
        lo, hi = int(edges[k]), int(min(edges[k + 1], edges[k] + 100_000))
        drawn += rng.binomial(many, strength / (strength + discount * np.arange(lo, hi))).sum()
        if edges[k + 1] > hi:  # of very many tables, the rest in one
            drawn += rng.poisson(many * strength / discount * math.log((strength + discount * edges[k + 1]) / (strength + discount * hi)))
    return float(np.clip(rng.gamma(1 + drawn) / (1 - wait), 1e-3, 1e9)), discount


# ---- jobs ----------------------------------------------------------------------------------------

_SENT = "to int, source int, unit string, ids array<{kind}>, block binary, stats array<struct<kind:int,key:long,n:double>>"
_STATS = pa.list_(pa.struct([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.float64())]))


def _row(kind: pa.DataType, to: int | None = None, source: int | None = None, unit: str | None = None, ids: pa.Array | None = None, block: bytes | None = None, stats: list | None = None) -> pa.RecordBatch:
    held = None if stats is None else [{"kind": k, "key": i, "n": n} for k, i, n in stats]
    given = pa.nulls(1, pa.list_(kind)) if ids is None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays(
        [pa.array([to], pa.int32()), pa.array([source], pa.int32()), pa.array([unit], pa.string()), given, pa.array([block], pa.binary()), pa.array([held], _STATS)],
        names=["to", "source", "unit", "ids", "block", "stats"],
    )


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one number after the other; they come in order."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[column] != now:
                yield now, held
                held = []
            now = row[column]
            held.append(row)
    if held:
        yield now, held


def _bounds(words: np.ndarray, shards: int) -> np.ndarray:
    """Where the words of each shard, those of equal high bits, begin among words in order, and the end."""
    bits = shards.bit_length() - 1
    return np.concatenate([[0], np.searchsorted(words, np.arange(1, shards, dtype=np.uint64) << U64(BITS - bits)) if bits else np.empty(0, np.int64), [len(words)]]).astype(np.int64)


def _messages(b: Bucket, shards: int, kind: pa.DataType, number: int, common: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """What a bucket tells each shard: customers by word, and of shared dishes; at first also which they are."""
    words = b.words[b.served]
    bound = _bounds(words, shards)
    root, shared = b.sent()
    where = b.where[b.shared]
    cut = np.searchsorted(where, bound)
    count = None if common is None else _sum(b.where[b.to1], b.customers, len(b.served))
    for s in range(shards):
        lo, hi, x, y = bound[s], bound[s + 1], cut[s], cut[s + 1]
        if lo == hi:
            continue
        told = [_small(root[lo:hi]), _small(shared[x:y])]
        if common is not None:
            told = [*_split(words[lo:hi], common), _small(count[lo:hi]), told[0], _small(where[x:y] - lo), _small(b.hot1[b.in1[b.shared[x:y]]]), told[1]]
        yield _row(kind, to=s, source=number, block=_pack(*told))


def _merge_rows(folder: str, level, route, shards: int, kind: pa.DataType):
    """Each bucket's counts and tokens from all units' blocks, as files; its first messages; and what goes by unit, as it is."""

    def merged(number: int, rows: list[dict]) -> Bucket:
        to: Route = route.value
        blocks = []
        for r in rows:
            blocks.append(Block.of(r.pop("block")))
        used = np.zeros(len(to.common), dtype=bool)
        for b in blocks:
            for c in (b.p1, b.w, b.p2):
                used[c[c < len(used)]] = True
        words = np.unique(np.concatenate([to.common[used], *(b.rare for b in blocks)]))
        common = np.searchsorted(words, to.common).astype(np.int32)
        columns: list[list[np.ndarray]] = [[], [], []]
        for b in blocks:
            number_of = np.concatenate([common, np.searchsorted(words, b.rare).astype(np.int32)])
            for out, c in zip(columns, (b.p1, b.w, b.p2), strict=True):
                out.append(number_of[c])
            b.p1 = b.w = b.p2 = None
        for k in range(3):
            columns[k] = np.concatenate(columns[k])
        bucket, row = Bucket.of(words, columns, np.concatenate([~b.held[b.doc] for b in blocks]), level.value.pairs)
        tokens, at = [], 0
        for r, b in zip(rows, blocks, strict=True):
            own = row[at : at + len(b.doc)]
            order = np.argsort(own, kind="stable")
            tokens.append((r["unit"], _pack(_small(np.diff(own[order], prepend=0)), _small(b.doc[order]))))
            at += len(b.doc)
        _write(f"{folder}/tokens/{number}", b"".join([struct.pack("<I", len(tokens)), *(struct.pack("<32sQ", u.encode(), len(t)) + t for u, t in tokens)]))
        return bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _groups(batches, "bucket"):
            if number < 0:
                for r in rows:
                    yield _row(kind, unit=r["unit"], ids=pa.array(r["ids"], kind), block=r["block"])
                continue
            b = merged(number, rows)
            rows.clear()
            common = route.value.in_order
            _write(f"{folder}/counts/{number}", b.static(common))
            b.spread(level.value)
            b.begin()
            _write(f"{folder}/seats-0/{number}", b.seats())
            yield from _messages(b, shards, kind, number, common)
            some = np.flatnonzero(b.hot2 >= 0)
            yield _row(kind, stats=_by_key(_CUSTOMERS2, b.hot2[some], _sum(b.in2, b.customers, b.n_pairs)[some]))

    return run


def _tokens(folder: str, number: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(unit, row, text) of a bucket's tokens."""
    data = _read(f"{folder}/tokens/{number}")
    (n,), at = struct.unpack_from("<I", data), 4
    for _ in range(n):
        unit, size = struct.unpack_from("<32sQ", data, at)
        at += 40
        row, doc = _unpack(data[at : at + size])
        at += size
        yield unit.rstrip(b"\0").decode(), np.cumsum(row, dtype=np.int64), doc


def _shard_rows(folder: str, level, common, k: int, seed: int, kind: pa.DataType):
    """Over the buckets' messages: each shard's draw, its replies and its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Level = level.value
        for number, rows in _groups(batches, "to"):
            told = [(r["source"], r["block"]) for r in rows]
            if k == 0:
                s = Shard(told, common.value)
                messages = {b: (p[3], p[6]) for b, p in ((b, _unpack(block)) for b, block in told)}
                _write(f"{folder}/shards/{number}", s.static())
            else:
                s = Shard.load(_read(f"{folder}/shards/{number}"))
                s.tables0, s.tables1 = (a.astype(np.int64) for a in _unpack(_read(f"{folder}/roots-{k - 1}/{number}")))
                messages = {b: tuple(_unpack(block)) for b, block in told}
            s.draw(known, messages, np.random.default_rng([seed, k, 1, number]) if k else None)
            _write(f"{folder}/roots-{k}/{number}", _pack(_small(s.tables0), _small(s.tables1)))
            stats = [(_SUMS, 0, float(s.customers0.sum())), (_SUMS, 1, float(s.tables0.sum())), *_dish_stats(0, s.customers0, s.tables0), *_dish_stats(1, s.customers1, s.tables1)]
            if k == 0:
                stats += [(_SUMS, 2, float(s.count.sum())), (_SUMS, 3, float((s.count > 0).sum()))]
            n = len(known.words)
            stats += [*_by_key(_CUSTOMERS1, np.arange(n), _sum(s.hot, s.customers1, n)), *_by_key(_TABLES1, np.arange(n), _sum(s.hot, s.tables1, n))]
            yield _row(kind, stats=stats)
            for b, _ in told:
                yield _row(kind, to=b, source=number, block=_pack(*map(_small, s.reply(b, k == 0))))

    return run


def _told(rows: list[dict]) -> list[np.ndarray]:
    """The replies of all shards to a bucket, in order of shard and so of word."""
    parts = [_unpack(r["block"]) for r in rows]
    return [np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(len(parts[0]))]


def _seated(folder: str, level: Level, common: np.ndarray, number: int, k: int, told: list[np.ndarray]) -> Bucket:
    """A bucket as it is after sweep k and its shards' draw."""
    b = Bucket.load(_read(f"{folder}/counts/{number}"), common)
    b.spread(level)
    b.sit(_read(f"{folder}/seats-{k}/{number}"))
    b.told(told[2], told[3])
    return b


def _sweep_rows(folder: str, level, common, k: int, seed: int, shards: int, keep: bool, kind: pa.DataType):
    """Over the shards' replies: each bucket's sweep k, its messages and its sums; `keep` keeps the replies for predictions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Level = level.value
        for number, rows in _groups(batches, "to"):
            told = _told(rows)
            b = _seated(folder, known, common.value, number, k - 1, told)
            if k == 1:
                _write(f"{folder}/known/{number}", _pack(_small(told[4])))
            if keep:
                _write(f"{folder}/told-{k - 1}/{number}", _pack(*map(_small, told[:4])))
            rng = np.random.default_rng([seed, k, 0, number])
            b.sweep(known, told[0], told[1], rng)
            _write(f"{folder}/seats-{k}/{number}", b.seats())
            yield from _messages(b, shards, kind, number)
            c1, t1, c2, t2 = b.totals(known)
            own1, own2 = b.hot1 < 0, b.hot2 < 0
            mine = np.zeros(b.n_pairs, np.int64) if own2.all() else _sum(b.in2, b.tables2, b.n_pairs)
            stats = [*_house_stats(1, c1[own1], t1[own1], known.strength[1], rng), *_house_stats(2, c2[own2], t2[own2], known.strength[2], rng)]
            stats += [*_dish_stats(1, b.customers1[b.own], b.tables1[b.own]), *_dish_stats(2, b.customers, b.tables2), *_by_key(_TABLES2, b.hot2[~own2], mine[~own2])]
            yield _row(kind, stats=stats)

    return run


def _score_rows(folder: str, samples, common, last: int, kind: pa.DataType):
    """Over the shards' last replies: each bucket's part of the sums of each text, by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _groups(batches, "to"):
            told, total, b = _told(rows), 0.0, None
            for k, level in samples.value:
                if b is None:
                    b = Bucket.load(_read(f"{folder}/counts/{number}"), common.value)
                    b.spread(level)
                said = told if k == last else [a.astype(np.int64) for a in _unpack(_read(f"{folder}/told-{k}/{number}"))]
                b.sit(_read(f"{folder}/seats-{k}/{number}"))
                b.told(said[2], said[3])
                total = total + b.probabilities(level, said[0], said[1])
            level = samples.value[-1][1]
            count = (told[4] if len(told) > 4 else _unpack(_read(f"{folder}/known/{number}"))[0].astype(np.int64))[b.where[b.to1]]
            logs = np.log10(total / len(samples.value))
            base = np.log10((count + 0.5) / (level.tokens + 0.5 * (level.types + 1)))
            known = (count > 0).astype(np.float64)
            for unit, row, doc in _tokens(folder, number):
                texts = np.flatnonzero(np.bincount(doc))
                add = lambda v, row=row, doc=doc, texts=texts: np.bincount(doc, v[row])[texts]
                yield _row(kind, unit=unit, source=number, block=_pack(_small(texts), _small(add(known).round().astype(np.int64)), add(base), add(logs)))

    return run


def _text_rows(samples):
    """Over a unit's rows, its texts before the sums of buckets: one row per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = samples.value[-1][1].tokens
        ids, sums = None, []

        def done():
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(np.full(len(ids), tokens, np.int64)), pa.array(sums[2]), pa.array(sums[3])],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        for batch in batches:
            for i, head in enumerate(batch.column("head").to_pylist()):
                block = _unpack(batch.column("block")[i].as_py())
                if head:
                    if ids is not None:
                        yield done()
                    ids = batch.column("ids")[i].values
                    sums = [block[0].astype(np.float64), *np.zeros((3, len(ids)))]
                    continue
                for total, value in zip(sums[1:], block[1:], strict=True):
                    total[block[0]] += value
        if ids is not None:
            yield done()

    return run


def _collected(sent: DataFrame) -> dict[int, dict[int, float]]:
    """Sums of what tasks report, by kind and key."""
    rows = sent.filter("stats is not null").select(F.explode("stats").alias("s")).groupBy("s.kind", "s.key").agg(F.sum("s.n").alias("n")).toArrow()
    out: dict[int, dict[int, float]] = {}
    for kind, key, n in zip(*(rows.column(c).to_pylist() for c in ("kind", "key", "n")), strict=True):
        out.setdefault(kind, {})[key] = n
    return out


def _array(found: dict[int, float] | None, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for i, v in (found or {}).items():
        out[i] = round(v)
    return out


def _next_level(level: Level, up: dict, down: dict, fixed: bool, rng: np.random.Generator) -> Level:
    """The totals after a draw of buckets and shards, with strengths and discounts drawn from them."""
    sums = down.get(_SUMS, {})
    new = Level(level.strength, level.discount, level.tokens or round(sums.get(2, 0)), level.types or round(sums.get(3, 0)), round(sums.get(0, 0)), round(sums.get(1, 0)), level.words, level.pairs)
    new.customers1, new.tables1 = _array(down.get(_CUSTOMERS1), len(level.words)), _array(down.get(_TABLES1), len(level.words))
    new.customers2 = level.customers2 if len(level.customers2) else _array(up.get(_CUSTOMERS2), len(level.pairs))
    new.tables2 = _array(up.get(_TABLES2), len(level.pairs))
    if fixed or not new.tables0:
        return new
    strength, discount = list(level.strength), list(level.discount)
    for i, (c, t) in enumerate(((np.array([new.customers0]), np.array([new.tables0])), (new.customers1, new.tables1), (new.customers2, new.tables2))):
        houses, dishes, wait = dict(up.get(_HELD + i, {})), dict(up.get(_DISH + i, {})), sum(up.get(_WAIT + i, {}).values())
        for kind, key, n in _house_stats(i, c, t, strength[i], rng):
            if kind == _HELD + i:
                houses[key] = houses.get(key, 0) + n
            else:
                wait += n
        for key, n in down.get(_DISH + i, {}).items():
            dishes[key] = dishes.get(key, 0) + n
        large = {k: up.get(_LARGE + i, {}).get(k, 0.0) + down.get(_LARGE + i, {}).get(k, 0.0) for k in range(len(GRID))}
        strength[i], discount[i] = _resample(strength[i], houses, dishes, wait, rng, large)
    new.strength, new.discount = tuple(strength), tuple(discount)
    return new


@dataclass
class Trained:
    """What is left after the last sweep: the common words, the kept levels, the shards' last replies, the units' texts, and the files."""

    folder: str
    buckets: int
    common: object
    samples: list[tuple[int, Level]]
    replies: DataFrame
    heads: DataFrame


def _common(rows: DataFrame, folder: str, hot: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(about how many tokens there are, words and pairs of words before about `hot` of them, the most frequent words)."""
    found = rows.mapInArrow(_common_rows, "words int, code long, n long").groupBy("words", "code").agg(F.sum("n").alias("n"))
    found = _store.save(found, f"{folder}/common")
    many = found.filter((F.col("n") >= hot) & (F.col("words") > 0)).toArrow()
    code, kind = many.column("code").to_numpy().view(np.uint64), many.column("words").to_numpy()
    best = found.filter("words = 1").orderBy(F.desc("n"), "code").limit(COMMON).toArrow().column("code").to_numpy().view(np.uint64)
    tokens = found.filter("words = 0").agg(F.sum("n")).first()[0] or 0
    _store.drop(rows.sparkSession, f"{folder}/common")
    return tokens, np.sort(code[kind == 1]), np.sort(code[kind == 2]), best


def train(rows: DataFrame, folder: str, bucket_tokens: int = BUCKET_TOKENS, burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = 7, hot: int = HOT, unit_tokens: int = UNIT_TOKENS, fan: int = FAN, fixed: tuple | None = None) -> Trained:
    """Learn from the rows (doc_id, text, held) that are not held; tokens of the others are counted with weight 0.

    `fixed` strengths and discounts are kept as they are; else they are drawn after each sweep.
    """
    spark = rows.sparkSession
    doc_kind = rows.schema["doc_id"].dataType
    kind = pa.schema(rows.select("doc_id").limit(0).toArrow().schema).field("doc_id").type
    ddl, dealt = _SENT.format(kind=doc_kind.simpleString()), f"bucket int, unit string, ids array<{doc_kind.simpleString()}>, block binary"
    many, words, pairs, common = _common(rows, folder, hot)
    buckets = max(4, -(-many // bucket_tokens))
    shards = 1 << (buckets - 1).bit_length()
    level = Level(*(fixed or START), words=words, pairs=pairs)
    ways = Route(buckets, words, pairs, common)
    route, known = spark.sparkContext.broadcast(ways), spark.sparkContext.broadcast(ways.in_order)
    own = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    coarse = math.isqrt(buckets - 1) + 1 if buckets > fan else None
    tokens = rows.mapInArrow(_deal_rows(route, unit_tokens, coarse), dealt)
    if coarse:
        tokens = tokens.repartitionById(coarse, F.pmod(own, F.lit(coarse))).mapInArrow(_again_rows(route), dealt)
    held = spark.sparkContext.broadcast(level)
    ordered = partitioned(tokens.withColumn("own", own), "own", buckets).sortWithinPartitions("own", "bucket", "unit").drop("own")
    first = _store.save(ordered.mapInArrow(_merge_rows(folder, held, route, shards, kind), ddl), f"{folder}/up-0")
    up, sent, kept = first, _collected(first), []
    del tokens, ordered
    spark._jvm.System.gc()  # files of a shuffle go once nothing on the driver can read it again: these are the largest
    for k in range(burn_in + samples + 1):
        if k:
            due = partitioned(down.filter("to is not null").select("to", "source", "block"), "to", buckets).sortWithinPartitions("to", "source")
            up = _store.save(due.mapInArrow(_sweep_rows(folder, held, known, k, seed, shards, k - 1 > burn_in, kind), ddl), f"{folder}/up-{k}")
            sent = _collected(up)
            _store.drop(spark, f"{folder}/down-{k - 1}")
            if k - 1 <= burn_in:
                _store.drop(spark, f"{folder}/seats-{k - 1}")
        due = partitioned(up.filter("to is not null").select("to", "source", "block"), "to", shards).sortWithinPartitions("to", "source")
        down = _store.save(due.mapInArrow(_shard_rows(folder, held, known, k, seed, kind), ddl), f"{folder}/down-{k}")
        if k:
            _store.drop(spark, f"{folder}/up-{k}")
            _store.drop(spark, f"{folder}/roots-{k - 1}")
        held.destroy()
        level = _next_level(level, sent, _collected(down), fixed is not None or k == 0, np.random.default_rng([seed, k, 2]))
        held = spark.sparkContext.broadcast(level)
        if k > burn_in:
            kept.append((k, level))
    heads = first.filter("to is null and unit is not null").select("unit", "ids", "block")
    return Trained(folder, buckets, known, kept, down.filter("to is not null").select("to", "source", "block"), heads)


def held_out(doc_id) -> F.Column:
    """Texts that are not learnt from: crc32 of doc_id as text leaves 1 when divided by 5; false for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 1, F.lit(False))


def score(documents: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, bucket_tokens: int = BUCKET_TOKENS, seed: int = 7, **options) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Learns from all texts that are not held out and scores all.  Null and empty texts are an end token
    alone.  Without training texts every word is unknown and all scores come from the base.  Repeated rows
    count, and are scored, as often as they occur; an empty table gives no rows.
    """
    spark = documents.sparkSession
    folder = _store.new_folder(spark, "seats")
    rows = documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held"))
    doc_kind = rows.schema["doc_id"].dataType.simpleString()
    t = train(rows, folder, bucket_tokens, burn_in, samples, seed, **options)
    kind = pa.schema(rows.select("doc_id").limit(0).toArrow().schema).field("doc_id").type
    held = spark.sparkContext.broadcast(t.samples)
    due = partitioned(t.replies, "to", t.buckets).sortWithinPartitions("to", "source")
    sums = due.mapInArrow(_score_rows(folder, held, t.common, burn_in + samples, kind), _SENT.format(kind=doc_kind)).select("unit", F.lit(False).alias("head"), "source", "ids", "block")
    all_rows = t.heads.select("unit", F.lit(True).alias("head"), F.lit(-1).alias("source"), "ids", "block").unionByName(sums)
    ordered = all_rows.repartition("unit").sortWithinPartitions("unit", F.desc("head"), "source")
    out = ordered.select("head", "ids", "block").mapInArrow(_text_rows(held), f"doc_id {doc_kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
