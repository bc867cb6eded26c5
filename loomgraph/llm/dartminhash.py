"""MinHash near-dedup by DartMinHash: hashed darts thrown into weighted element regions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import _store
from loomgraph.llm._store import free_name
from loomgraph.llm._text import U64, VISIBLE, Tokens, mix, pieces, powers, release, released, runs, shingles, text_bytes, tokenize

WIDTH = 5
COORDS = 64
ROWS_PER_BAND = 3
THRESHOLD = 0.8


def cells(tok: Tokens, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(cell, text index): a word shingle that occurs w times in a text fills w unit cells of its region.

    The m-th cell of a shingle is the same in all texts, so common cells of two texts count the smaller
    weight, and their weighted Jaccard similarity is the plain one of their cells.  Ordered by text.
    """
    hashes, docs = shingles(tok, width)
    order = np.argsort(mix(hashes + docs.astype(np.uint64) * U64(0xE7037ED1A0B428DB)), kind="stable")
    hashes, docs = hashes[order], docs[order]
    start = runs(hashes ^ (docs.astype(np.uint64) << U64(48)))
    nth = np.arange(len(hashes)) - np.repeat(start, np.diff(np.append(start, len(hashes))))
    found = mix(hashes + nth.astype(np.uint64) * U64(0xA0761D6478BD642F))
    order = np.argsort(docs, kind="stable")
    return found[order], docs[order]


def _throw(cell: np.ndarray, docs: np.ndarray, limit: np.ndarray, n: int, coords: int) -> tuple[np.ndarray, np.ndarray]:
    """Earliest dart (its hash, its rank) per text and coordinate, of ranks up to each text's limit.

    Darts fall on a unit cell as a Poisson process in rank: the gaps between them are exponential,
    drawn from hashes of the cell and the dart's number, hence alike in every text that holds the cell.
    """
    best = np.full(n * coords, np.inf)
    name = np.zeros(n * coords, np.uint64)
    rank = np.zeros(len(cell))
    most, number = limit[docs], 0
    while len(cell):
        number += 1
        dart = mix(cell + U64(number * 0x8EBC6AF09C88C6E3 % 2**64))
        rank = rank - np.log(((dart >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        live = rank <= most
        cell, docs, rank, most, dart = cell[live], docs[live], rank[live], most[live], dart[live]
        named = mix(dart)
        slot = docs * coords + (named % U64(coords)).astype(np.int64)
        np.minimum.at(best, slot, rank)
        won = best[slot] == rank
        name[slot[won]] = named[won]
    return name.reshape(n, coords), best.reshape(n, coords)


def signatures(cell: np.ndarray, docs: np.ndarray, n: int, coords: int = COORDS) -> np.ndarray:
    """A 64-bit name per text and coordinate; equal with a probability of the weighted Jaccard similarity.

    So many darts are thrown that few coordinates stay empty; texts that have some get twice as many.
    Texts without words keep zeros.
    """
    out = np.zeros((n, coords), np.uint64)
    weight = np.bincount(docs, minlength=n)
    todo = np.flatnonzero(weight)
    darts = coords * math.log(coords) + 2 * coords
    while len(todo):
        limit = np.zeros(n)
        limit[todo] = darts / weight[todo]
        chosen = np.ones(len(cell), dtype=bool) if len(todo) == n else limit[docs] > 0
        name, rank = _throw(cell[chosen], docs[chosen], limit, n, coords)
        out[todo] = name[todo]
        todo = todo[~np.isfinite(rank[todo]).all(axis=1)]
        darts *= 2
    return out


def bands(signature: np.ndarray, rows: int = ROWS_PER_BAND) -> np.ndarray:
    """One hash per band of `rows` coordinates and text."""
    count = signature.shape[1] // rows
    total = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), (len(signature), count)).copy()
    for j in range(rows):
        total = mix(total * U64(0xC6BC279692B5C323) + signature[:, j : count * rows : rows])
    return total


def word_keys(tok: Tokens) -> np.ndarray:
    """Two 64-bit hashes of each text's words in order; equal word sequences have equal keys."""
    begin = np.searchsorted(tok.doc, np.arange(tok.n_docs + 1))
    out = np.zeros((tok.n_docs, 2), np.uint64)
    some = np.flatnonzero(np.diff(begin))
    if len(some):
        place = np.arange(len(tok.hash)) - begin[tok.doc]
        for k, base in enumerate((0x9FB21C651E98DF25, 0xD1342543DE82EF95)):
            out[some, k] = mix(np.add.reduceat(tok.hash * powers(base, int(place.max()))[place], begin[some]) + np.diff(begin)[some].astype(np.uint64))
    return out


# ---- distributed operator ------------------------------------------------------------------------

#: Rows of an id and a key up to which a table is broadcast.
NARROW = 500_000
#: Bytes of text that are handled at once.
PIECE = 512 << 10
#: Keys of a bucket that are compared in one task; a larger bucket is compared block by block.
BLOCK = 2048


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def _key_column(keys: np.ndarray) -> pa.Array:
    """Keys as 16-byte values; null where a text has no words."""
    flat = pa.py_buffer(np.ascontiguousarray(keys).astype(">u8").tobytes())
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, flat])
    return pc.if_else(pa.array(keys.any(axis=1)), fixed.cast(pa.binary()), pa.scalar(None, pa.binary()))


def _signed_rows(width: int, coords: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(released(batches), "text", PIECE):
            tok = tokenize(*text_bytes(batch.column("text")), VISIBLE)
            cell, docs = cells(tok, width)
            found = bands(signatures(cell, docs, batch.num_rows, coords), rows)
            size = found.shape[1]
            at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _key_column(word_keys(tok)), pa.ListArray.from_arrays(at, pa.array(_signed(found.ravel())))],
                names=["doc_id", "key", "bands"],
            )

    return run


def _cell_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(released(batches), "text", PIECE):
            tok = tokenize(*text_bytes(batch.column("text")), VISIBLE)
            cell, docs = cells(tok, width)
            bound = np.searchsorted(docs, np.arange(batch.num_rows + 1))
            packed = [np.sort(cell[a:b]).tobytes() for a, b in zip(bound[:-1], bound[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([_key_column(word_keys(tok)), pa.array(packed, pa.binary())], names=["key", "cells"])

    return run


def _spanning(keys: list[bytes], sets: list[np.ndarray], blocks: np.ndarray | None, threshold: float) -> list[tuple[bytes, bytes]]:
    """Links of similarity `threshold` or more that connect all that such links connect among these keys.

    One key after another is compared exactly with all keys it is not yet connected to whose sizes allow
    the threshold; keys of the largest connected part need no turn of their own once the others had theirs.
    With two blocks, only keys of different blocks are compared.
    """
    n = len(keys)
    part = np.arange(n)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    start = np.cumsum(sizes) - sizes
    done = np.zeros(n, dtype=bool)
    links = []
    while True:
        count = np.bincount(part[~done], minlength=n)
        if (count > 0).sum() <= 1 and (part == part[0]).all():
            break
        waiting = np.flatnonzero(~done)
        total = np.bincount(part, minlength=n)
        waiting = waiting[part[waiting] != int(np.argmax(total))]
        if not len(waiting):
            break
        i = int(waiting[0])
        done[i] = True
        other = part != part[i]
        if blocks is not None:
            other &= blocks != blocks[i]
        ratio = np.minimum(sizes, sizes[i]) / np.maximum(sizes, sizes[i])
        near = np.flatnonzero(other & (ratio >= threshold))
        if not len(near):
            continue
        for lo in range(0, len(near), 512):
            some = near[lo : lo + 512]
            take = np.concatenate([flat[start[j] : start[j] + sizes[j]] for j in some])
            own = sets[i]
            at = np.minimum(np.searchsorted(own, take), len(own) - 1)
            common = np.add.reduceat((own[at] == take).astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            linked = some[common >= threshold * (sizes[some] + sizes[i] - common) - 1e-9]
            for j in linked.tolist():
                if part[j] != part[i]:
                    part[part == part[j]] = part[i]
                    links.append((keys[i], keys[j]))
    return links


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one (v, left, right) after the other; they come in order."""
    held: list[dict] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            for row in batch.slice(lo, 256).to_pylist():
                if held and (row["v"], row["left"], row["right"]) != (held[0]["v"], held[0]["left"], held[0]["right"]):
                    yield held
                    held = []
                held.append(row)
        release()
    if held:
        yield held


def _link_rows(threshold: float):
    def solve(rows: list[dict]) -> list[tuple[bytes, bytes]]:
        sets = [np.frombuffer(r["cells"], np.uint64) for r in rows]
        blocks = np.array([r["block"] for r in rows]) if rows[0]["left"] != rows[0]["right"] else None
        return _spanning([r["key"] for r in rows], sets, blocks, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            if out := solve(rows):
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return run


def _star_rows(threshold: float):
    """Of each key of a block whether it is linked to the one key that stands for the whole bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            hub = next(r for r in rows if r["hub"])
            own, rest = np.frombuffer(hub["cells"], np.uint64), [r for r in rows if not r["hub"]]
            sets = [np.frombuffer(r["cells"], np.uint64) for r in rest]
            common = np.array([len(np.intersect1d(own, s, assume_unique=True)) for s in sets])
            size = np.array([len(s) for s in sets])
            linked = common >= threshold * (size + len(own) - common) - 1e-9
            yield pa.RecordBatch.from_arrays(
                [pa.array([hub["v"]] * len(rest), pa.int64()), pa.array([r["key"] for r in rest], pa.binary()), pa.array([hub["key"]] * len(rest), pa.binary()), pa.array(linked, pa.bool_())],
                names=["v", "key", "hub", "linked"],
            )

    return run


def _placed(members: DataFrame, held: DataFrame, threshold: float, block: int, folder: str) -> tuple[DataFrame, DataFrame | None]:
    """(members of buckets with the blocks they are compared in, links that are known already).

    A bucket of up to `block` keys is one block.  In a larger one every key is first compared with the
    bucket's least key; those linked to it are connected, so what remains are the pairs of which one side is
    not.  Its blocks are compared with one another and with all blocks of linked keys.
    """
    spark = members.sparkSession
    number = lambda n: F.ceil(n / block).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("key"), number(n)).cast("int")
    small = members.filter(F.col("n") <= block).select("v", "key", F.lit(0).alias("block"), F.lit(0).alias("left"), F.lit(0).alias("right"))
    large = members.filter(F.col("n") > block)
    if large.isEmpty():
        return small, None
    spread = large.filter("key != k").select("v", "key", deal(F.col("n")).alias("left"), F.lit(False).alias("hub"))
    hubs = large.filter("key = k").select("v", "key", F.explode(F.sequence(F.lit(0), number(F.col("n")) - 1)).alias("left"), F.lit(True).alias("hub"))
    rows = spread.unionByName(hubs).join(held, "key").withColumn("right", F.col("left"))
    star = rows.repartition("v", "left").sortWithinPartitions("v", "left", "key").mapInArrow(_star_rows(threshold), "v long, key binary, hub binary, linked boolean")
    star = _store.save(star, f"{folder}/stars")
    count = _store.save(star.groupBy("v").agg(F.sum(F.col("linked").cast("long")).alias("n_linked"), F.sum((~F.col("linked")).cast("long")).alias("n_open")).filter("n_open > 0"), f"{folder}/open")
    met = star.join(_store.light(count), "v")
    a, b = number(F.col("n_open")), number(F.col("n_linked"))
    open_ = met.filter("not linked").withColumn("block", deal(F.col("n_open"))).withColumn("other", F.explode(F.sequence(F.lit(0), a + b - 1)))
    # a linked key meets every open block, and only those
    shut = met.filter("linked").withColumn("block", a + deal(F.col("n_linked"))).withColumn("other", F.explode(F.sequence(F.lit(0), a - 1)))
    pairs = open_.unionByName(shut).select("v", "key", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    return small.unionByName(pairs), star.filter("linked").select(F.col("hub").alias("a"), F.col("key").alias("b"))


def _components(links: DataFrame, folder: str) -> DataFrame:
    """(key, root): the least key each key is connected to, by alternating large and small stars.

    Every round is written to the shared folder; the links of a key are never gathered in one row.
    """
    spark = links.sparkSession
    same = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        kept = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return kept.filter("a != b").distinct()

    edges, before, turn = _store.save(links.filter("a != b").distinct(), f"{folder}/links-0"), None, 0
    while True:
        now = same(edges)
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("key"), F.col("b").alias("root"))
        before, turn = now, turn + 1
        larger = star(edges, True)
        edges = _store.save(star(larger, False), f"{folder}/links-{turn}")
        _store.drop(spark, f"{folder}/links-{turn - 1}")


def classes(documents: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, coords: int = COORDS, rows: int = ROWS_PER_BAND, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, key (of its words) and class (the least key of its class; both null without words).

    Words stand between ASCII white space; A-Z are lower-cased.  Texts of equal words share a key and are
    handled as one.  Texts of weighted Jaccard similarity `threshold` or more over shingles of `width` words
    are linked; classes are what links connect.  Candidates share a band of DartMinHash coordinates: a pair
    at the threshold is missed with a probability of (1 - threshold**rows) ** (coords // rows), 3e-7 by
    default.  Buckets with the same members are compared once; within a bucket every pair that is not yet
    connected is compared exactly, in blocks of `block` keys, and only connecting links leave the task.
    Null and blank texts belong to no class; an empty table gives no rows; repeated rows keep their number.
    """
    spark = documents.sparkSession
    folder = _store.new_folder(spark, "near")
    docs = documents.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = _store.save(docs.mapInArrow(_signed_rows(width, coords, rows), f"doc_id {kind}, key binary, bands array<long>"), f"{folder}/signed")
    texts = signed.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    banded = texts.select("key", F.explode("bands").alias("v"))
    bucket = banded.groupBy("v").agg(F.count("*").alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("s"), F.min("key").alias("k")).filter("n > 1")
    bucket = bucket.groupBy("n", "s", "k").agg(F.min("v").alias("v")).select("v", "n", "k")
    members = _store.save(banded.join(bucket, "v"), f"{folder}/members")
    wanted = members.select("key").distinct().join(texts.select("key", "doc_id"), "key").select(F.col("doc_id").alias("_id")).distinct()
    wanted = _store.light(_store.save(wanted, f"{folder}/wanted"), NARROW)
    some = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_id"]), "left_semi").select("text")
    held = some.mapInArrow(_cell_rows(width), "key binary, cells binary").filter("key is not null").dropDuplicates(["key"])
    placed, known = _placed(members, held, threshold, block, folder)
    grouped = placed.join(held, "key").repartition("v", "left", "right").sortWithinPartitions("v", "left", "right", "key")
    links = grouped.select("v", "left", "right", "block", "key", "cells").mapInArrow(_link_rows(threshold), "a binary, b binary")
    links = links if known is None else links.unionByName(known)
    roots = _components(links, folder)
    _store.drop(spark, f"{folder}/members")
    return signed.select("doc_id", "key").join(roots, "key", "left").select("doc_id", "key", F.coalesce("root", "key").alias("class"))


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Per document: doc_id, class_id (the least doc_id of its class) and class_size.

    A text without words is in a class of its own, of size 1.
    """
    got = classes(documents, threshold, **options)
    folder = _store.new_folder(documents.sparkSession, "classes")
    known = got.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")).filter("class_size > 1")
    known = _store.light(_store.save(known, f"{folder}/known"))
    return got.join(known, "class", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def _with_key(at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(released(batches), at, PIECE):
            tok = tokenize(*text_bytes(batch.column(at)), VISIBLE)
            yield pa.RecordBatch.from_arrays([*batch.columns, _key_column(word_keys(tok))], names=[*batch.schema.names, name])

    return run


def keep_one(documents: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents, as they are, with one row of each class: that of the least doc_id (null last).

    Texts without words all stay.  Of several rows with that id and the same words the least one stays, by
    text and then by all columns written as JSON.  Columns of any name are carried through.
    """
    columns = documents.columns
    folder = _store.new_folder(documents.sparkSession, "kept")
    got = _store.save(classes(documents, threshold, **options).filter("class is not null"), f"{folder}/got")
    best = got.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("c"))
    rows = got.join(best, "class").select("doc_id", "key", (F.col("doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("key") == F.col("c.key"))).alias("chosen"))
    told = rows.groupBy("doc_id", "key").agg(F.first("chosen").alias("chosen"), F.count("*").alias("n"))
    told = _store.save(told.filter("not chosen or n > 1"), f"{folder}/told")
    key, one, chosen_id, chosen_key = (free_name(columns, n) for n in ("key", "one", "told_id", "told_key"))
    schema = T.StructType([*documents.schema.fields, T.StructField(key, T.BinaryType())])
    keyed = documents.mapInArrow(_with_key(columns.index("text"), key), schema)
    named = lambda cond: told.filter(cond).select(F.col("doc_id").alias(chosen_id), F.col("key").alias(chosen_key))
    gone, again = named("not chosen"), named("chosen")
    same = lambda other: (keyed[key] == other[chosen_key]) & keyed["doc_id"].eqNullSafe(other[chosen_id])
    small = told.count() <= NARROW
    gone = F.broadcast(gone) if small else gone.hint("merge")
    left = keyed.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return left.select(*columns)
    again = F.broadcast(again) if small else again.hint("merge")
    once = left.join(again, same(again), "left_anti").select(*columns)
    order = Window.partitionBy(chosen_key, chosen_id).orderBy("text", F.to_json(F.struct(*[keyed[c] for c in columns])))
    first = keyed.join(again, same(again)).withColumn(one, F.row_number().over(order)).filter(F.col(one) == 1).select(*[keyed[c] for c in columns])
    return once.unionByName(first)
