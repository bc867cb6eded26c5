"""Suffix-array dedup by bucket-pointer refinement: bytes covered by long strings that repeat are removed.

A string of LENGTH bytes is sorted into the bucket of one of its q-grams: the one with the least hash,
the leftmost of equals, so equal strings go to equal buckets at equal offsets.  Neighbouring strings that
share this q-gram form a run.  Buckets with one run are done: nothing in them repeats.  The others are
refined by the identifiers of what follows at later offsets: runs that are equal as a whole need no more;
of each kind of run one goes on to a refinement string by string, where identifiers of LENGTH bytes come
from those of GRAM bytes by joining each with the one at a later offset, reused for twice the length.

Strings count as equal by their bucket and two identifiers of 64 bits with different codes and bases; within
a task the bytes are compared as well.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import _store
from loomgraph.llm._text import BYTE_CODE, INVERSE, RADIX, U64, mix, pieces, powers, runs, seeded, text_bytes

LENGTH = 200
#: Bytes of the initial q-grams.
GRAM = 64
#: Start positions handled at once.
CHUNK = 1 << 20
_PLACE = 21
#: Kinds of runs of a bucket that are refined in one task; those of a larger bucket are dealt out string by string.
BUCKET = 4096


#: Byte codes, base and its inverse of each of the two identifiers.
_FIRST = (BYTE_CODE, RADIX, INVERSE)
_OTHER_RADIX = 0xC2B2AE3D27D4EB4F
_OTHER = (seeded(256, 29), _OTHER_RADIX, pow(_OTHER_RADIX, -1, 2**64))


def _sums(data: np.ndarray, kind: tuple) -> np.ndarray:
    """Prefix sums that give the identifier of any stretch."""
    code, base, _ = kind
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * powers(base, len(data))[: len(data)], out=prefix[1:])
    return prefix


def gram_buckets(data: np.ndarray, gram: int, kind: tuple = _FIRST) -> tuple[np.ndarray, np.ndarray]:
    """(identifier of the `gram` bytes from each position, prefix sums for strings of any length)."""
    prefix = _sums(data, kind)
    n = len(data) - gram + 1
    return mix((prefix[gram:] - prefix[:-gram]) * powers(kind[2], len(data))[:n]), prefix


def refine(bucket: np.ndarray, have: int, want: int) -> np.ndarray:
    """Identifiers of `want` bytes from those of `have`: each joined with the one at a later offset, again and again."""
    while have < want:
        step = min(have, want - have)
        bucket = mix(bucket[:-step] * U64(0x9E6C63D0876A9A35) + bucket[step:])
        have += step
    return bucket


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values, from running minima of blocks of that width."""
    n = len(values) - width + 1
    pad = -len(values) % width
    grid = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def text_runs(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(bucket, both identifiers of the whole run, text index, first and last start in the text) of all runs."""
    out: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, max(0, len(raw) - length + 1), CHUNK):
        data = raw[lo : lo + CHUNK + length - 1]
        n = len(data) - length + 1
        grams, prefix = gram_buckets(data, gram)
        keyed = (grams >> U64(_PLACE) << U64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
        place = (window_minimum(keyed, length - gram + 1) & U64((1 << _PLACE) - 1)).astype(np.int64)
        doc = np.searchsorted(offsets, np.arange(lo, lo + n), side="right") - 1 if len(offsets) < 3 else np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, lo, lo + n)))
        inside = np.arange(lo, lo + n) + length <= offsets[doc + 1]
        opens = inside.copy()
        opens[1:] &= (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | ~inside[1:]
        first, last = np.flatnonzero(opens), np.flatnonzero(closes)
        whole = [mix((p[last + length] - p[first]) * powers(k[2], len(data))[first]) for p, k in ((prefix, _FIRST), (_sums(data, _OTHER), _OTHER))]
        which = doc[first]
        out.append((grams[place[first]], *whole, which, first + lo - offsets[which], last + lo - offsets[which]))
    if not out:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _checks(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    view = memoryview(np.ascontiguousarray(raw))
    return np.array([zlib.crc32(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint32).view(np.int32)


def _run_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", CHUNK):
            raw, offsets = text_bytes(batch.column("text"))
            bucket, whole, other, doc, first, last = text_runs(raw, offsets, length, gram)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket.view(np.int64)),
                    pa.array(whole.view(np.int64)),
                    pa.array(other.view(np.int64)),
                    batch.column("doc_id").take(pa.array(doc)),
                    pa.array(_checks(raw, offsets)[doc]),
                    pa.array(first.astype(np.int32)),
                    pa.array(last.astype(np.int32)),
                ],
                names=["bucket", "whole", "other", "doc_id", "check", "first", "last"],
            )

    return run


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in pieces(batches, "text", CHUNK):
        raw, offsets = text_bytes(batch.column("text"))
        view = memoryview(np.ascontiguousarray(raw))
        texts = [pack.compress(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(_checks(raw, offsets)), pa.array(texts, pa.binary())],
            names=["doc_id", "check", "packed"],
        )


def _asked_rows(length: int):
    """Of each text the bytes of the runs that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                out: dict[str, list] = {k: [] for k in ("bucket", "large", "row", "first", "bytes")}
                for i, (packed, asked) in enumerate(zip(part.column("packed"), part.column("asked").to_pylist(), strict=True)):
                    text = unpack.decompress(packed.as_buffer())
                    for a in asked:
                        out["bucket"].append(a["bucket"])
                        out["large"].append(a["large"])
                        out["row"].append(i)
                        out["first"].append(a["first"])
                        out["bytes"].append(text[a["first"] : a["last"] + length])
                row = pa.array(out["row"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out["bucket"], pa.int64()),
                        pa.array(out["large"], pa.bool_()),
                        part.column("doc_id").take(row),
                        part.column("check").take(row),
                        pa.array(out["first"], pa.int32()),
                        pa.array(out["bytes"], pa.binary()),
                    ],
                    names=["bucket", "large", "doc_id", "check", "first", "bytes"],
                )

    return run


def _strings(batch: pa.RecordBatch, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(both identifiers, row, start in the row, place in the bytes) of all strings of the given runs, and the bytes."""
    column = pc.cast(batch.column("bytes"), pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    found, other = (refine(gram_buckets(raw, gram, kind)[0], gram, length) for kind in (_FIRST, _OTHER))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(found)]
    inside = np.flatnonzero(np.arange(len(found)) + length <= offsets[row + 1])
    return found[inside], other[inside], row[inside], inside - offsets[row[inside]], inside, raw


def repeated(keys: tuple[np.ndarray, ...], at: np.ndarray, raw: np.ndarray, length: int) -> np.ndarray:
    """Which strings (each of `length` bytes, at a place of its own) equal another one.

    Strings are put together by their keys; then the bytes of each are compared with those of the first one
    of its kind, neighbouring strings whose firsts are neighbours at once.
    """
    order = np.lexsort(keys)
    begin = np.zeros(len(at), dtype=bool)
    for k in keys:
        begin[1:] |= k[order][1:] != k[order][:-1]
    begin[:1] = True
    start = np.flatnonzero(begin)
    size = np.diff(np.append(start, len(at)))
    twice = np.zeros(len(at), dtype=bool)
    twice[order] = np.repeat(size > 1, size)
    like = np.empty(len(at), np.int64)
    like[order] = np.repeat(at[order][start], size)
    some = np.flatnonzero(twice & (like != at))
    if len(some):
        cut = np.flatnonzero((np.diff(at[some]) != 1) | (np.diff(like[some]) != 1)) + 1
        view = memoryview(np.ascontiguousarray(raw))
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(some)], strict=True):
            p, q, n = int(at[some[a]]), int(like[some[a]]), b - a - 1 + length
            if view[p : p + n] != view[q : q + n]:
                return _repeated_bytes(at, view, length)
    return twice


def _repeated_bytes(at: np.ndarray, view: memoryview, length: int) -> np.ndarray:
    """The same by the bytes alone."""
    _, which, size = np.unique(np.array([bytes(view[p : p + length]).hex() for p in at.tolist()]), return_inverse=True, return_counts=True)
    return size[which] > 1


def _repeated_rows(length: int, gram: int):
    """Over runs in order of bucket: the byte ranges whose strings occur twice in their bucket."""

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, other, row, start, at, raw = _strings(batch, length, gram)
        bucket = batch.column("bucket").to_numpy()
        twice = repeated((other, found, bucket[row]), at, raw, length)
        row, start = row[twice], start[twice]
        cut = runs(row * (1 << 40) + start - np.arange(len(row)))
        end = np.append(cut[1:], len(row)) - 1 if len(cut) else cut
        take = pa.array(row[cut])
        base = batch.column("first").to_numpy()[row[cut]]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(take),
                batch.column("check").take(take),
                pa.array((base + start[cut]).astype(np.int32)),
                pa.array((base + start[end] + length).astype(np.int32)),
            ],
            names=["doc_id", "check", "begin", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                bucket = part.column("bucket").to_numpy()
                last = int(np.searchsorted(bucket, bucket[-1]))
                if held and last == 0 and held[-1].column("bucket")[-1].as_py() == bucket[0]:
                    held.append(part)
                    continue
                if not last:
                    if held:
                        yield solve(_joined(held))
                    held = [part]
                    continue
                yield solve(_joined([*held, part.slice(0, last)]))
                held = [part.slice(last)]
        if held:
            yield solve(_joined(held))

    return run


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _string_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                found, other, row, start, _, _ = _strings(part, length, gram)
                take = pa.array(row)
                begin = part.column("first").to_numpy()[row] + start
                yield pa.RecordBatch.from_arrays(
                    [part.column("bucket").take(take), pa.array(found.view(np.int64)), pa.array(other.view(np.int64)), part.column("doc_id").take(take), part.column("check").take(take), pa.array(begin.astype(np.int32)), pa.array((begin + length).astype(np.int32))],
                    names=["bucket", "string", "other", "doc_id", "check", "begin", "end"],
                )

    return run


def repeated_ranges(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_rows: int = BUCKET, folder: str | None = None) -> DataFrame:
    """(doc_id, check, begin, end): byte ranges covered by strings that start twice; ranges may overlap.

    `check` is the crc32 of the text, which tells texts of one doc_id apart.
    """
    spark = documents.sparkSession
    folder = folder or _store.new_folder(spark, "repeats")
    docs = documents.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = docs.mapInArrow(_run_rows(length, gram), f"bucket long, whole long, other long, doc_id {kind}, check int, first int, last int")
    ends = [f(c).alias(f"{n}_{c}") for c in ("whole", "other") for f, n in ((F.min, "low"), (F.max, "high"))]
    live = placed.groupBy("bucket").agg(F.count("*").alias("n"), *ends).filter("n > 1")
    # written first: a small table is broadcast, and a join with a table, not with an aggregate, is one whose hot buckets can be split
    live = _store.save(live.select("bucket", F.expr("low_whole != high_whole or low_other != high_other").alias("mixed")), f"{folder}/live")
    active = _store.save(placed.join(_store.light(live), "bucket"), f"{folder}/active")
    _store.drop(spark, f"{folder}/live")
    mixed, kind_of = active.filter("mixed"), ["bucket", "whole", "other"]
    kinds = mixed.groupBy(*kind_of).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "check", "first", "last")).alias("one"))
    kinds = _store.save(kinds, f"{folder}/kinds")
    large = _store.save(kinds.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows).select("bucket", F.lit(True).alias("large")), f"{folder}/large")
    asked = kinds.join(_store.light(large), "bucket", "left").select("bucket", F.coalesce("large", F.lit(False)).alias("large"), "one")
    asked = asked.groupBy("one.doc_id", "one.check").agg(F.collect_list(F.struct("bucket", "large", "one.first", "one.last")).alias("asked"))
    texts = docs.mapInArrow(_packed_rows, f"doc_id {kind}, check int, packed binary")
    asked = asked.select(F.col("doc_id").alias("_id"), F.col("check").alias("_check"), "asked")
    met = texts.join(asked, texts["doc_id"].eqNullSafe(asked["_id"]) & (texts["check"] == asked["_check"])).select("doc_id", "check", "packed", "asked")
    bits = met.mapInArrow(_asked_rows(length), f"bucket long, large boolean, doc_id {kind}, check int, first int, bytes binary").dropDuplicates(["bucket", "doc_id", "check", "first"])
    bits = _store.save(bits, f"{folder}/asked")
    ranges = f"doc_id {kind}, check int, begin int, end int"
    small = bits.filter("not large").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeated_rows(length, gram), ranges)
    strings = bits.filter("large").mapInArrow(_string_rows(length, gram), f"bucket long, string long, other long, {ranges}")
    equal = ["bucket", "string", "other"]
    again = strings.groupBy(*equal).agg(F.count("*").alias("n")).filter("n > 1").select(*equal)
    big = strings.join(again, equal).select("doc_id", "check", "begin", "end")
    common = _store.save(kinds.filter("n > 1").select(*kind_of), f"{folder}/common")
    whole = active.filter("not mixed").unionByName(mixed.join(_store.light(common), kind_of))
    whole = whole.select("doc_id", "check", F.col("first").alias("begin"), (F.col("last") + length).alias("end"))
    return whole.unionByName(small).unionByName(big)


def _merged(ranges: list | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for r in sorted((r["begin"], r["end"]) for r in ranges or []):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append([*r])
    return [tuple(r) for r in out]


def _finished(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for packed, ranges in zip(part.column("packed"), part.column("ranges").to_pylist(), strict=True):
                    text = unpack.decompress(packed.as_buffer())
                    spans = _merged(ranges)
                    kept, at = [], 0
                    for a, b in spans:
                        kept.append(text[at:a])
                        at = b
                    left = b"".join([*kept, text[at:]])
                    gone = sum(b - a for a, b in spans)
                    rows.append((len(text), gone, len(spans), hashlib.sha256(left).hexdigest() if digest else left, [{"begin": a, "end": b} for a, b in spans]))
                cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
                if digest:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols, pa.array([r[3] for r in rows], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
                else:
                    spans = pa.array([r[4] for r in rows], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols, pa.array([r[3] for r in rows], pa.binary()), spans], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return run


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_rows: int = BUCKET, digest: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, and `kept` (bytes left) with `spans`, or kept_sha256.

    Texts are UTF-8 bytes and a null one is empty; strings never cross two texts, and are judged on the
    input.  Each row counts as a document, so a row that occurs twice repeats all its strings; ranges of equal
    rows are gathered once.  A cut may fall inside a character, hence bytes.  An empty table gives no rows.
    """
    docs = documents.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = repeated_ranges(docs, length, gram, bucket_rows).groupBy("doc_id", "check").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("check").alias("_check"), "ranges")
    texts = docs.mapInArrow(_packed_rows, f"doc_id {kind}, check int, packed binary")
    met = texts.join(found, texts["doc_id"].eqNullSafe(found["_id"]) & (texts["check"] == found["_check"]), "left").select("doc_id", "packed", "ranges")
    base = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long"
    return met.mapInArrow(_finished(digest), f"{base}, kept_sha256 string" if digest else f"{base}, kept binary, spans array<struct<begin:long,end:long>>")
