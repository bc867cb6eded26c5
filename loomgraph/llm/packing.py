"""Variable-capacity best-fit packing of token ids into sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import _store, tokenbin
from loomgraph.llm._ranges import partitioned
from loomgraph.llm._text import pieces, released

CAPACITIES = (512, 1024, 2048, 4096)
#: What a sequence costs besides its length, in tokens.
OVERHEAD = 32
#: Tokens that are packed together.
GROUP_TOKENS = 4_000_000
#: Sequences in a batch of the result.
BATCH = 256


def _place(lengths: list[int], capacities: tuple[int, ...], opening: Callable[[int, int], int]) -> tuple[list[int], list[int]]:
    """Best fit in the given order: (bin of each item, capacity each bin was opened with).

    Open bins stand in lists by free room; a bit per room tells which lists hold any, so the tightest
    bin that fits is the lowest bit from the item's length up.
    """
    by_room: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]
    rooms, where, opened, left = 0, [], [], sum(lengths)
    for n in lengths:
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            held = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room = opening(n, left)
            held = len(opened)
            opened.append(room)
        where.append(held)
        left -= n
        if room > n:
            by_room[room - n].append(held)
            rooms |= 1 << (room - n)
    return where, opened


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, final capacity of each bin); items go from long to short.

    A new bin takes the size of least cost per token it can expect to hold.  As sizes decide jointly how
    well later items fit, this is done with every set of sizes that may be opened (an item longer than all
    of a set opens the least size that holds it), and the plan of least total cost is kept.  At the end each
    bin shrinks to the smallest permitted size that holds its contents.  Lengths must be between 1 and the
    largest capacity.
    """
    order = np.argsort(-lengths, kind="stable")
    todo = lengths[order].tolist()
    sizes = np.array(capacities)
    best = None
    for usual in (c for k in range(1, len(capacities) + 1) for c in combinations(capacities, k)):

        def opening(n: int, left: int, usual=usual) -> int:
            fits = [c for c in usual if c >= n] or [next(c for c in capacities if c >= n)]
            return min(fits, key=lambda c: ((c + overhead) / min(c, left), c))

        where, _ = _place(todo, capacities, opening)
        content = np.bincount(where, weights=todo).astype(np.int64)
        final = sizes[np.searchsorted(sizes, content)]
        cost = float(final.sum() + overhead * len(final))
        if best is None or cost < best[0]:
            best = (cost, np.asarray(where), final)
    if best is None or not todo:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    out = np.empty(len(todo), np.int64)
    out[order] = best[1]
    return out, best[2]


def _width(tokenizer: str) -> str:
    """The type that holds every id of the tokenizer."""
    return "<u2" if len(tokenbin._encoder(tokenizer).spaced) <= 1 << 16 else "<u4"


def _encoded_rows(tokenizer: str):
    """Ids of each text with the end id, as little-endian integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = tokenbin._encoder(tokenizer), np.dtype(_width(tokenizer))
        for batch in pieces(released(batches), "text", 1 << 20):
            ids, counts = encoder.encode(batch.column("text"))
            bound = kind.itemsize * np.concatenate([[0], np.cumsum(counts)])
            raw = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bound.astype(np.int64)), pa.py_buffer(ids.astype(kind).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("check"), pa.array(counts.astype(np.int32)), raw], names=["doc_id", "check", "length", "ids"])

    return run


class Plan:
    """Pieces of a group's documents in order of sequence and place: full sequences of long documents come last."""

    def __init__(self, length: np.ndarray, capacities: tuple[int, ...], overhead: float) -> None:
        most = capacities[-1]
        full, rest = length // most, length % most
        loose = np.flatnonzero(rest)
        where, capacity = best_fit(rest[loose], capacities, overhead)
        whole = np.repeat(np.arange(len(length)), full)
        number = np.concatenate([full[loose], np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)])
        bins = np.concatenate([where, len(capacity) + np.arange(len(whole))])
        order = np.argsort(bins, kind="stable")
        self.doc = np.concatenate([loose, whole])[order]
        self.fragment = number[order]
        self.start = self.fragment * most
        self.length = np.concatenate([rest[loose], np.full(len(whole), most)])[order]
        self.bin = bins[order]
        self.capacity = np.concatenate([capacity, np.full(len(whole), most)])
        #: The first piece of each sequence, and the end.
        self.first = np.searchsorted(self.bin, np.arange(len(self.capacity) + 1))


def _pack(capacities: tuple[int, ...], overhead: float, width: str):
    def emit(group: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = pa.concat_arrays([p.column("doc_id") for p in parts])
        length = np.concatenate([p.column("length").to_numpy() for p in parts]).astype(np.int64)
        ids = np.concatenate([np.frombuffer(r.as_buffer(), width) for p in parts for r in p.column("ids")])
        begin = np.cumsum(length) - length
        plan = Plan(length, capacities, overhead)
        for lo in range(0, len(plan.capacity), BATCH):
            hi = min(len(plan.capacity), lo + BATCH)
            some = slice(plan.first[lo], plan.first[hi])
            size = plan.length[some]
            at = np.cumsum(size) - size
            flat = ids[np.repeat(begin[plan.doc[some]] + plan.start[some] - at, size) + np.arange(size.sum())]
            cut = plan.first[lo : hi + 1] - plan.first[lo]
            held = np.append(at, size.sum())[cut]
            offset = at - np.repeat(held[:-1], np.diff(cut))
            piece = pa.StructArray.from_arrays(
                [docs.take(pa.array(plan.doc[some])), *(pa.array(v.astype(t)) for v, t in ((plan.fragment[some], np.int32), (plan.start[some], np.int64), (size, np.int32), (offset, np.int32)))],
                names=["doc_id", "fragment", "start", "length", "bin_offset"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(lo, hi) + (group << 32), pa.int64()),
                    pa.array(plan.capacity[lo:hi].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(held.astype(np.int32)), pa.array(flat.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), piece),
                ],
                names=["bin_id", "capacity", "ids", "pieces"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts = None, []
        for batch in batches:
            groups = batch.column("group").to_numpy()
            for lo in [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist()] if len(groups) else []:
                if groups[lo] != group:
                    if parts:
                        yield from emit(group, parts)
                    group, parts = int(groups[lo]), []
                parts.append(batch.slice(lo, int(np.searchsorted(groups, group, side="right")) - lo))
        if parts:
            yield from emit(group, parts)

    return run


def _with_copies(rows: DataFrame, folder: str) -> DataFrame:
    """The rows with a number among equal ones, so that these can be dealt like others, whatever the layout of the table."""
    keys = ["doc_id", "check"]
    twice = _store.save(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1"), f"{folder}/twice")
    if twice.isEmpty():
        return rows.withColumn("copy", F.lit(0))
    marked = twice.select(F.col("doc_id").alias("_id"), F.col("check").alias("_check"), "n")
    met = rows.join(_store.light(marked), rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["check"] == F.col("_check")), "left").drop("_id", "_check")
    once = met.filter("n is null").drop("n").withColumn("copy", F.lit(0))
    more = met.filter("n is not null").dropDuplicates(keys).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))).drop("n")
    return once.unionByName(more)


def sequences(
    documents: DataFrame,
    tokenizer: str | None = None,
    capacities: tuple[int, ...] = CAPACITIES,
    overhead: float = OVERHEAD,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """The packed sequences: bin_id, capacity (the size to pad to), ids, and pieces (doc_id, fragment, start, length, bin_offset).

    Texts are encoded by the tokenizer, each with its end id.  A document longer than the largest capacity
    fills whole sequences of its own with its first pieces, and its last piece is packed with the others.
    Documents are dealt by a hash of id and text into groups of about `group_tokens`, packed one by one: only
    the last few sequences of a group are less than full.  The result does not depend on the order or the
    partitions of the input.  Null and empty texts are their end id alone; a null id is an id like others;
    repeated rows are packed as often as they occur; an empty table gives no rows.
    """
    spark = documents.sparkSession
    capacities, tokenizer = tuple(sorted(set(capacities))), tokenizer or tokenbin.default_tokenizer()
    folder = _store.new_folder(spark, "packing")
    texts = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("check"), "text")
    kind = texts.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("check", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("ids", T.BinaryType())]
    rows = _store.save(texts.mapInArrow(_encoded_rows(tokenizer), T.StructType(fields)), f"{folder}/ids")
    groups = int((rows.agg(F.sum(F.col("length").cast("long"))).first()[0] or 0) // group_tokens + 1)
    dealt = _with_copies(rows, folder).withColumn("group", F.pmod(F.xxhash64("doc_id", "check", "copy"), F.lit(groups)).cast("int"))
    ordered = partitioned(dealt, "group", groups).sortWithinPartitions("group", F.desc("length"), "doc_id", "check", "copy")
    ddl = f"bin_id long, capacity int, ids array<int>, pieces array<struct<doc_id:{kind.simpleString()},fragment:int,start:long,length:int,bin_offset:int>>"
    return ordered.select("group", "doc_id", "length", "ids").mapInArrow(_pack(capacities, overhead, _width(tokenizer)), ddl)


def placements(packed: DataFrame) -> DataFrame:
    """Of each piece of each document, read back from the sequences: doc_id, fragment, start, length, bin_id, capacity, bin_offset, ids_hash."""
    own = lambda p: F.slice("ids", p["bin_offset"] + 1, p["length"])
    hashed = F.transform("pieces", lambda p: F.struct(p.alias("p"), F.xxhash64(own(p)).alias("ids_hash")))
    rows = packed.select("bin_id", "capacity", F.explode(hashed).alias("x"))
    return rows.select("x.p.doc_id", "x.p.fragment", "x.p.start", "x.p.length", "bin_id", "capacity", "x.p.bin_offset", "x.ids_hash")
