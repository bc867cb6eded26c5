"""Substring dedup by fixed-block anchors: words covered by a long window that an earlier document has are removed.

Each document is cut into non-overlapping reference blocks of BLOCK words, the anchors; any WINDOW consecutive
words hold a whole one of them.  Every rolling window of BLOCK words probes the index of anchors.  Where a probe
hits a block of another document, the hit is extended word by word to both sides: each window of WINDOW words
over it is looked up among the windows over other hits, with the least doc_id that has it, and what neighbouring
windows cover together is a maximal exact repeat.

Both look-ups are exchanges.  Documents lie in pieces of a few MB; a piece asks each shard of the hash space for
its distinct hashes in one packed row, whatever the number of their places, and the shard answers only what other
pieces share.  So neither a passage that a third of all documents hold nor a group of copies makes a large group:
a piece asks for it once, no pairs of documents are formed, and no hit is left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import _store
from loomgraph.llm._text import INVERSE, RADIX, U64, VISIBLE, Tokens, mix, pieces, powers, runs, text_bytes, tokenize

WINDOW = 50
#: Bytes of text of a piece; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20
#: Words whose hashes one shard looks up, and the most shards there are: beyond them shards grow with the input.
SHARD_WORDS = 1_000_000
SHARDS = 20_000
#: Bits of an anchor's hash beyond those that number all words: a hash alone takes one probe in 2**SPARE for a hit,
#: which the windows, told apart by 96 bits, then do not confirm.
SPARE = 10
_OTHER_RADIX = 0xC2B2AE3D27D4EB4F


def block_words(window: int) -> int:
    """The longest block of which every window, wherever it starts, holds a whole one."""
    return (window + 1) // 2


def _planes(values: np.ndarray) -> bytes:
    """The bytes of all values by their place in a value, for the compressor."""
    return values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def _values(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length as one compressed string; the first must ascend."""
    steps = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    return zstandard.compress(np.int64(len(steps)).tobytes() + b"".join(_planes(np.ascontiguousarray(c)) for c in (steps, *columns[1:])), 1)


def unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n, at, out = int(np.frombuffer(raw[:8], np.int64)[0]), 8, []
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(_values(raw[at : at + size], k) if n else np.empty(0, k))
        at += size
    return [np.cumsum(out[0], dtype=out[0].dtype), *out[1:]]


def _rolling(codes: np.ndarray, width: int, base: int) -> np.ndarray:
    """The hash of each `width` neighbouring codes, from prefix sums."""
    n = len(codes)
    if n < width:
        return np.empty(0, np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * powers(base, n)[:n], out=prefix[1:])
    inverse = INVERSE if base == RADIX else pow(base, -1, 2**64)
    return mix((prefix[width:] - prefix[:-width]) * powers(inverse, n)[: n - width + 1])


@dataclass
class Piece:
    """Documents of a piece with their words."""

    ids: pa.Array
    raw: np.ndarray
    offsets: np.ndarray
    tokens: Tokens
    #: doc_id of each text, 0 where it is null, and whether it has one.
    doc: np.ndarray
    known: np.ndarray

    @classmethod
    def opened(cls, payload: pa.Buffer) -> Piece:
        batch = pa.ipc.open_stream(payload).read_next_batch()
        raw, offsets = text_bytes(batch.column(1))
        ids = batch.column(0)
        return cls(ids, raw, offsets, tokenize(raw, offsets, VISIBLE, lower=False), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False))

    def starts(self, width: int) -> np.ndarray:
        """Which words start `width` words of one text that has an id."""
        owner = self.tokens.doc
        n = max(0, len(owner) - width + 1)
        return (owner[:n] == owner[len(owner) - n :]) & self.known[owner[:n]]


def anchor_asks(piece: Piece, block: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start of each probe, place of its hash among the distinct ones, the distinct hashes, their marks).

    Mark 1: the hash of a reference block of this piece; 2: documents of different ids here have it.
    """
    at = np.flatnonzero(piece.starts(block))
    hashes = _rolling(piece.tokens.hash, block, RADIX)[at] >> U64(64 - bits)
    asked, which = np.unique(hashes, return_inverse=True)
    owner = piece.tokens.doc[at]
    first = np.searchsorted(piece.tokens.doc, np.arange(len(piece.doc)))
    marks = np.zeros(len(asked), np.uint8)
    marks[which[(at - first[owner]) % block == 0]] = 1
    ids = piece.doc[owner]
    low = np.full(len(asked), np.iinfo(np.int64).max)
    high = np.full(len(asked), np.iinfo(np.int64).min)
    np.minimum.at(low, which, ids)
    np.maximum.at(high, which, ids)
    marks[low < high] |= 2
    return at, which, asked, marks


def window_asks(piece: Piece, window: int, block: int, hits: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start of each window over a hit, place of its hash among the distinct ones, these hashes, their checks, the least doc_id of each here).

    `hits` are starts of blocks.
    """
    n = len(piece.tokens.hash)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(hits - (window - block), 0), 1)
    np.add.at(change, hits + 1, -1)
    near = np.cumsum(change[:n]) > 0
    ok = piece.starts(window)
    at = np.flatnonzero(near[: len(ok)] & ok)
    hashes = _rolling(piece.tokens.hash, window, RADIX)[at]
    checks = (_rolling(mix(piece.tokens.hash), window, _OTHER_RADIX)[at] >> U64(32)).astype(np.uint32)
    order = np.lexsort((checks, hashes))
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (checks[order][1:] != checks[order][:-1])
    which = np.empty(len(at), np.int64)
    which[order] = np.cumsum(fresh) - 1
    low = np.full(int(fresh.sum()), np.iinfo(np.int64).max)
    np.minimum.at(low, which, piece.doc[piece.tokens.doc[at]])
    return at, which, hashes[order][fresh], checks[order][fresh], low


def _shard_of(hashes: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Equal ranges of the hash space."""
    top = hashes >> U64(max(0, bits - 32))
    return (top * U64(shards) >> U64(min(bits, 32))).astype(np.int32)


def _by_shard(number: int, hashes: np.ndarray, bits: int, shards: int, *columns: np.ndarray) -> pa.RecordBatch:
    shard = _shard_of(hashes, bits, shards)
    cut = runs(shard)
    blobs = [packed(*(c[a:b] for c in (hashes, *columns))) for a, b in zip(cut.tolist(), np.append(cut, len(shard))[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(shard[cut]), pa.array(np.full(len(cut), number, np.int64)), pa.array(blobs, pa.binary())], names=["shard", "piece", "blob"])


_ASKS = "shard int, piece long, blob binary"


def _pieces_of(piece_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options, base, count = pa.ipc.IpcWriteOptions(compression="zstd"), TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def closed() -> pa.RecordBatch:
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                writer.write_batch(batch)
            words = int(Piece.opened(sink.getvalue()).tokens.per_doc().sum())
            return pa.RecordBatch.from_arrays([pa.array([base + count]), pa.array([words]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["piece", "words", "payload"])

        for part in pieces(batches, "text", piece_bytes):
            more = int(part.column("text").nbytes)
            if held and size + more > piece_bytes:
                yield closed()
                held, size, count = [], 0, count + 1
            held.append(part)
            size += more
        if held:
            yield closed()

    return run


def _ask_anchors(block: int, bits: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                piece = Piece.opened(batch.column("payload")[i].as_buffer())
                _, _, asked, marks = anchor_asks(piece, block, bits)
                yield _by_shard(batch.column("piece")[i].as_py(), asked, bits, shards, marks)

    return run


def _replies(asks: pa.Table, blobs: list[bytes | None]) -> pa.Table:
    some = pa.array([i for i, b in enumerate(blobs) if b is not None], pa.int64())
    return pa.table({"shard": asks.column("shard").take(some), "piece": asks.column("piece").take(some), "blob": pa.array(blobs, pa.binary()).drop_null()})


def _answer_anchors(asks: pa.Table) -> pa.Table:
    """To each piece the places, among what it asked of this shard, of the blocks that documents of different ids share."""
    got = [unpacked(b.as_py(), np.uint64, np.uint8) for b in asks.column("blob")]
    value, which, times = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True, return_counts=True)
    marks = np.concatenate([g[1] for g in got])
    held = np.zeros(len(value), dtype=bool)
    held[which[marks & 1 > 0]] = True
    shared = times > 1
    shared[which[marks & 2 > 0]] = True
    live, at, out = (held & shared)[which], 0, []
    for g in got:
        places = np.flatnonzero(live[at : at + len(g[0])]).astype(np.uint32)
        out.append(packed(places) if len(places) else None)
        at += len(g[0])
    return _replies(asks, out)


def _answer_windows(asks: pa.Table) -> pa.Table:
    """To each piece the windows that a document of another piece has under a smaller id than any of its own, with this id."""
    got = [unpacked(b.as_py(), np.uint64, np.uint32, np.int64) for b in asks.column("blob")]
    hashes, checks, ids = (np.concatenate([g[k] for g in got]) for k in range(3))
    order = np.lexsort((checks, hashes))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (checks[order][1:] != checks[order][:-1])
    least = np.empty(len(order), np.int64)
    group = np.cumsum(fresh) - 1
    least[order] = np.minimum.reduceat(ids[order], np.flatnonzero(fresh))[group] if len(order) else ids
    at, out = 0, []
    for g in got:
        mine = least[at : at + len(g[0])]
        places = np.flatnonzero(mine < g[2])
        out.append(packed(places.astype(np.uint32), mine[places]) if len(places) else None)
        at += len(g[0])
    return _replies(asks, out)


def _answers(rows: list | None, hashes: np.ndarray, bits: int, shards: int, *kinds: type) -> list[np.ndarray]:
    """The answers of all shards, their places counted among all distinct hashes of the piece."""
    begin = np.searchsorted(_shard_of(hashes, bits, shards), np.arange(shards))
    parts = [(begin[r["shard"]], unpacked(r["blob"], np.uint32, *kinds)) for r in rows or []]
    places = np.concatenate([np.empty(0, np.int64), *(p[0].astype(np.int64) + b for b, p in parts)])
    return [places, *(np.concatenate([np.empty(0, k), *(p[i + 1] for _, p in parts)]) for i, k in enumerate(kinds))]


def _hits(piece: Piece, rows: list | None, block: int, bits: int, shards: int) -> np.ndarray:
    at, which, asked, _ = anchor_asks(piece, block, bits)
    live = np.zeros(len(asked), dtype=bool)
    live[_answers(rows, asked, bits, shards)[0]] = True
    return at[live[which]]


def _ask_windows(window: int, bits: int, shards: int):
    block = block_words(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                piece = Piece.opened(batch.column("payload")[i].as_buffer())
                hits = _hits(piece, batch.column("blocks")[i].as_py(), block, bits, shards)
                _, _, hashes, checks, low = window_asks(piece, window, block, hits)
                yield _by_shard(batch.column("piece")[i].as_py(), hashes, 64, shards, checks, low)

    return run


def _covered(piece: Piece, blocks: list | None, windows: list | None, window: int, bits: int, shards: int) -> np.ndarray:
    """Which words are removed."""
    block, n = block_words(window), len(piece.tokens.hash)
    at, which, hashes, _, low = window_asks(piece, window, block, _hits(piece, blocks, block, bits, shards))
    places, ids = _answers(windows, hashes, 64, shards, np.int64)
    low[places] = ids
    gone = at[low[which] < piece.doc[piece.tokens.doc[at]]]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, gone, 1)
    np.add.at(change, gone + window, -1)
    return np.cumsum(change[:n]) > 0


def _finished(window: int, bits: int, shards: int, digest: bool):
    def done(piece: Piece, gone: np.ndarray) -> pa.RecordBatch:
        view, out = memoryview(np.ascontiguousarray(piece.raw)), []
        begin = np.searchsorted(piece.tokens.doc, np.arange(len(piece.doc) + 1))
        for k in range(len(piece.doc)):
            words, cut = bytes(view[piece.offsets[k] : piece.offsets[k + 1]]).split(), gone[begin[k] : begin[k + 1]]
            spans: list[dict] = []
            if cut.any():
                words = [w for w, c in zip(words, cut.tolist(), strict=True) if not c]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8))).reshape(-1, 2)
                spans = [{"begin": a, "end": b} for a, b in edge.tolist()]
            left = b" ".join(words)
            out.append((len(cut), int(cut.sum()), hashlib.sha256(left).hexdigest() if digest else left.decode(), spans))
        counts = [pa.array([r[i] for r in out], pa.int64()) for i in range(2)]
        text = pa.array([r[2] for r in out], pa.string())
        if digest:
            return pa.RecordBatch.from_arrays([piece.ids, *counts, text], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
        spans = pa.array([r[3] for r in out], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
        return pa.RecordBatch.from_arrays([piece.ids, *counts, text, spans], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                piece = Piece.opened(batch.column("payload")[i].as_buffer())
                yield done(piece, _covered(piece, batch.column("blocks")[i].as_py(), batch.column("windows")[i].as_py(), window, bits, shards))

    return run


def remove_repeats(documents: DataFrame, window: int = WINDOW, piece_bytes: int = PIECE_BYTES, shard_words: int = SHARD_WORDS, digest: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, and `kept` (its other words, one space between two) with `spans`, or kept_sha256.

    Words lie between ASCII white space and are compared as they are.  A word goes if it lies in `window`
    consecutive words that a document of a smaller doc_id (an integer) has too; windows are judged on the input.
    `spans` are the maximal runs of removed words.  A null or empty text has no words.  Rows of equal doc_id do
    not count against one another, and a row without doc_id is compared with none: it keeps all words.  Each row
    gives one row; an empty table gives none.
    """
    spark = documents.sparkSession
    block = block_words(window)
    folder = _store.new_folder(spark, "anchors")
    docs = documents.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.mapInArrow(_pieces_of(piece_bytes), "piece long, words long, payload binary")
    dealt = _store.kept_dealt(cut, "piece")
    words = dealt.agg(F.sum("words")).first()[0] or 0
    shards = max(1, min(SHARDS, words // shard_words))
    bits = min(64, math.ceil(math.log2(words + 2)) + SPARE)
    listed = F.collect_list(F.struct("shard", "blob"))

    asked = dealt.select("piece", "payload").mapInArrow(_ask_anchors(block, bits, shards), _ASKS)
    blocks = asked.groupBy("shard").applyInArrow(_answer_anchors, _ASKS)
    blocks = _store.save(blocks, f"{folder}/blocks").groupBy("piece").agg(listed.alias("blocks"))
    both = dealt.join(blocks.hint("merge"), "piece")
    asked = both.select("piece", "payload", "blocks").mapInArrow(_ask_windows(window, bits, shards), _ASKS)
    windows = asked.groupBy("shard").applyInArrow(_answer_windows, _ASKS)
    windows = _store.save(windows, f"{folder}/windows").groupBy("piece").agg(listed.alias("windows"))
    met = dealt.join(blocks.hint("merge"), "piece", "left").join(windows.hint("merge"), "piece", "left").select("payload", "blocks", "windows")
    base = f"doc_id {kind}, n_words long, n_removed long"
    return met.mapInArrow(_finished(window, bits, shards, digest), f"{base}, kept_sha256 string" if digest else f"{base}, kept string, spans array<struct<begin:long,end:long>>")
