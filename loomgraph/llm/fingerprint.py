"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm._ranges import partitioned, with_range
from loomgraph.llm._text import U64, VISIBLE, mix, pieces, runs, seeded, shingles, text_bytes, tokenize

BINS = 256
BITS = 4
WIDTH = 5
#: Ranges whose first ids are broadcast; more are joined over a shuffle.
LISTED = 100_000
#: Bytes of text in a range of neighbouring documents.
RANGE_BYTES = 24 << 20


def _densify(sketch: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Give each empty bin the value of a bin that its own probe sequence meets first (the same for all texts)."""
    n, bins = sketch.shape
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    code = seeded(bins, 11)
    attempt = 0
    out = sketch.copy()
    while len(row):
        probe = (mix(code[col] + U64(attempt * 0xA24BAED4963EE407 % 2**64)) % U64(bins)).astype(np.int64)
        hit = filled[row, probe]
        out[row[hit], col[hit]] = sketch[row[hit], probe[hit]]
        row, col = row[~hit], col[~hit]
        attempt += 1
    return out


def sketch_texts(raw: np.ndarray, offsets: np.ndarray, bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(low-order bits per text and bin, whether the text has any shingle).

    Each word shingle is hashed once: high bits choose the bin, the rest compete for its minimum.
    """
    n = len(offsets) - 1
    tok = tokenize(raw, offsets, VISIBLE)
    hashes, docs = shingles(tok, width)
    binned = (hashes >> U64(32)) % U64(bins)
    value = hashes & U64(0xFFFFFFFF)
    low = np.zeros((n, bins), np.uint32)
    filled = np.zeros((n, bins), dtype=bool)
    per = max(1, (1 << 32) // bins - 1)
    for lo in range(0, n, per):
        hi = min(n, lo + per)
        a, b = np.searchsorted(docs, [lo, hi])
        key = np.sort((((docs[a:b] - lo).astype(np.uint64) * U64(bins) + binned[a:b]) << U64(32)) | value[a:b])
        first = runs(key >> U64(32))
        cell = (key[first] >> U64(32)).astype(np.int64)
        low[lo + cell // bins, cell % bins] = (key[first] & U64(0xFFFFFFFF)).astype(np.uint32)
        filled[lo + cell // bins, cell % bins] = True
    low = mix(_densify(low, filled).astype(np.uint64)) & U64((1 << bits) - 1)
    return low.astype(np.uint8), filled.any(axis=1)


def pack(low: np.ndarray, has: np.ndarray, bits: int = BITS) -> list[str]:
    """Hexadecimal strings of the bits of all bins; '' for a text without words."""
    flat = np.unpackbits(low[:, :, None], axis=2, bitorder="little")[:, :, :bits].reshape(len(low), -1)
    packed = np.packbits(flat, axis=1)
    return [p.tobytes().hex() if h else "" for p, h in zip(packed, has, strict=True)]


def unpack(fingerprint: str, bits: int = BITS) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), np.uint8))
    return np.packbits(flat.reshape(-1, bits), axis=1, bitorder="little")[:, 0]


def likeness(a: np.ndarray, b: np.ndarray, has_a: np.ndarray, has_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity: the share of equal bins, corrected for low bits that agree by chance.

    Two texts without words are alike (1); one without words is like no other (0).
    """
    chance = 0.5**bits
    share = (a == b).mean(axis=1)
    value = np.clip((share - chance) / (1 - chance), 0, 1)
    return np.where(has_a & has_b, value, (has_a == has_b).astype(float))


def _fingerprints(at: int, bins: int, bits: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            low, has = sketch_texts(*text_bytes(batch.column(at)), bins, bits, width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pack(low, has, bits), pa.string())], names=[*batch.schema.names, "fingerprint"])

    return run


def fingerprints(documents: DataFrame, bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """The documents with a column `fingerprint`; a null or blank text has ''. An own column of that name is replaced."""
    rows = documents.drop("fingerprint")
    ddl = T.StructType([*rows.schema.fields, T.StructField("fingerprint", T.StringType())])
    return rows.mapInArrow(_fingerprints(rows.columns.index("text"), bins, bits, width), ddl)


def _neighbours(bins: int, bits: int, width: int):
    """Over rows (part, guard, doc_id, text) in order: each with the text that follows it in its part."""

    def emit(rows: list[tuple], follower: str | None):
        ids = [r[1] for r in rows]
        texts = [r[2] for r in rows] + ([follower] if follower is not None else [])
        edited = []
        for i, (_, _, t) in enumerate(rows):
            k = len(t) // 4
            after = texts[i + 1] if i + 1 < len(texts) else ""
            edited.append(t[: len(t) - k] + after[:k])
        low, has = sketch_texts(*text_bytes(pa.array([*texts, *edited], pa.large_string())), bins, bits, width)
        n, m = len(rows), len(texts)
        f, ef = pack(low[:n], has[:n], bits), pack(low[m:], has[m:], bits)
        near_e = likeness(low[:n], low[m:], has[:n], has[m:], bits)
        nxt = np.minimum(np.arange(n) + 1, m - 1)
        near_n = likeness(low[:n], low[nxt], has[:n], has[nxt], bits)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array(f),
                pa.array(ef),
                pa.array(near_e),
                pa.array(near_n),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in pieces(batches, "text", 1 << 20):
            for part, guard, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "guard", "doc_id", "text")), strict=True):
                text = text or ""
                if held and held[-1][0] != part:  # the part's guard is missing only if nothing follows it
                    yield emit(held, None)
                    held, size = [], 0
                if guard:
                    if held:
                        yield emit(held, text)
                    held, size = [], 0
                    continue
                if size > 2 << 20:
                    yield emit(held, text)
                    held, size = [], 0
                held.append((part, doc, text))
                size += len(text)
        if held:
            yield emit(held, None)

    return run


def edit_check(documents: DataFrame, bins: int = BINS, bits: int = BITS, width: int = WIDTH, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of each text and of its edited form, with likenesses.

    The edited text has its last quarter replaced by the head of the document next in order (after the
    last: the first).  Documents are dealt into ranges of doc_id by approximate quantiles; the first row
    of each range also goes, as a guard, to the range before it, so neighbours meet without a global sort
    into one task.  Rows of one doc_id are ordered by text; a null id comes first; a null text is empty.
    A sole document follows itself.  An empty table gives no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs, parts = with_range(docs, range_bytes)
    head = F.min(F.struct(F.col("doc_id").isNotNull().alias("set"), "doc_id")).alias("m")
    heads = docs.groupBy("part").agg(head).select("part", "m.doc_id").toArrow().sort_by("part")
    rows = docs.select("part", F.lit(False).alias("guard"), "doc_id", "text")
    if heads.num_rows:
        part, first = heads.column("part").to_pylist(), heads.column("doc_id").to_pylist()
        wanted = documents.sparkSession.createDataFrame(list(zip(part, first[1:] + first[:1], strict=True)), "to int, head long")
        wanted = F.broadcast(wanted) if len(part) <= LISTED else wanted
        firsts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["head"])).groupBy("to").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"))
        rows = rows.unionByName(firsts.select(F.col("to").alias("part"), F.lit(True).alias("guard"), "doc_id", "text"))
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return partitioned(rows, "part", parts).sortWithinPartitions("part", "guard", "doc_id", "text").mapInArrow(_neighbours(bins, bits, width), ddl)
