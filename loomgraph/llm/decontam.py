"""Benchmark decontamination: a broadcast hash set of normalised test n-grams over training windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import _store
from loomgraph.llm._store import free_name
from loomgraph.llm._text import WORD, Tokens, pieces, released, runs, take_text, text_bytes, tokenize, windows

NGRAM = 10
#: Bytes of benchmark text whose windows are broadcast at once, about 5 bytes for each of them; a larger
#: benchmark is taken in blocks of whole items, each against all documents.
BLOCK_BYTES = 8 << 20


class HashSet:
    """The windows of one block of items: by width, sorted hashes of distinct windows, where the words of each
    stand in the block's text, and the items that hold it."""

    def __init__(self, items: pa.Array, texts: pa.Array, width: int = NGRAM) -> None:
        self.ids = items
        self.tokens = tokenize(*text_bytes(texts), WORD)
        count = self.tokens.per_doc()
        self.by_width: dict[int, tuple[np.ndarray, ...]] = {}
        for w in sorted({min(int(c), width) for c in count if c}):
            hashes, first = windows(self.tokens, w)
            own = np.minimum(count[self.tokens.doc[first]], width) == w
            self.by_width[w] = self._distinct(hashes[own], first[own], w)

    def _distinct(self, hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
        """(hash and first word of each distinct window, where its items begin in the last array, items)."""
        order = np.argsort(hashes, kind="stable")
        hashes, first = hashes[order], first[order]
        begin = runs(hashes)
        size = np.diff(np.append(begin, len(hashes)))
        number = np.repeat(np.arange(len(begin)), size)  # windows of one hash are one, unless their words differ
        extra = len(begin)
        for b, n in zip(begin[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            seen: dict[bytes, int] = {}
            for i in range(b, b + n):
                words = take_text(self.tokens, int(first[i]), width)
                if words not in seen:
                    seen[words] = int(number[b]) if not seen else extra
                    extra += len(seen) > 1
                number[i] = seen[words]
        item = self.tokens.doc[first]
        order = np.lexsort((item, number))
        number, item, hashes, first = number[order], item[order], hashes[order], first[order]
        fresh = np.ones(len(number), dtype=bool)
        fresh[1:] = (number[1:] != number[:-1]) | (item[1:] != item[:-1])
        number, item, hashes, first = number[fresh], item[fresh], hashes[fresh], first[fresh]
        start = runs(number)
        order = np.argsort(hashes[start], kind="stable")
        size = np.diff(np.append(start, len(number)))
        return hashes[start][order], first[start][order], start[order], size[order], item

    def find(self, column: pa.Array) -> tuple[Tokens, np.ndarray, np.ndarray, list[set]]:
        """(tokens, first token of each text and the end, hit tokens, numbers of the items each text holds)."""
        tok = tokenize(*text_bytes(column), WORD)
        change = np.zeros(len(tok.hash) + 1, np.int32)
        items: list[set] = [set() for _ in range(len(column))]
        for width, (hashes, first, start, size, item) in self.by_width.items():
            found, at = windows(tok, width)
            if not len(found) or not len(hashes):
                continue
            low = np.searchsorted(hashes, found)
            hit = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == found)
            for i, k, h in zip(at[hit].tolist(), low[hit].tolist(), found[hit].tolist(), strict=True):
                words = take_text(tok, i, width)
                while k < len(hashes) and hashes[k] == h:  # every hash hit is verified on the words
                    if take_text(self.tokens, int(first[k]), width) == words:
                        items[int(tok.doc[i])].update(item[start[k] : start[k] + size[k]].tolist())
                        change[i] += 1
                        change[i + width] -= 1
                        break
                    k += 1
        begin = np.searchsorted(tok.doc, np.arange(len(column) + 1))
        return tok, begin, np.flatnonzero(np.cumsum(change[:-1]) > 0), items

    def names(self, numbers: set) -> list[str]:
        """The ids of items as sorted strings; items without one are left out."""
        return [] if not numbers else sorted({str(i) for i in self.ids.take(pa.array(sorted(numbers), pa.int64())).to_pylist() if i is not None})


def _blocks(benchmark: DataFrame, width: int, block_bytes: int) -> tuple[int, Iterator[HashSet]]:
    """The number of blocks, and the benchmark as hash sets of bounded size (an item longer than a block stands in one with few others)."""
    rows = benchmark.select("item_id", "text").filter("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))

    def made() -> Iterator[HashSet]:
        for b in range(blocks):
            got = dealt.filter(F.col("block") == b).select("item_id", "text").toArrow()
            yield HashSet(got.column("item_id").combine_chunks(), got.column("text").combine_chunks(), width)

    return blocks, made()


def _hit_rows(known, at: int, names: tuple[str, str, str]):
    """The batch with n_words, indices of hit words, and items that were met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(released(batches), at):
            _, begin, hit, items = known.value.find(batch.column(at))
            of = np.searchsorted(begin, hit, side="right") - 1
            cut = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(np.diff(begin), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(hit - begin[of], pa.int32())),
                    pa.array([known.value.names(s) for s in items], pa.list_(pa.string())),
                ],
                names=[*batch.schema.names, *names],
            )

    return run


def _with_hits(documents: DataFrame, benchmark: DataFrame, width: int, block_bytes: int) -> tuple[DataFrame, list[str]]:
    """(the documents with n_words, hits and items under names that are free, those names).

    One block needs no shuffle.  With more, each block is scanned against all documents for the distinct texts
    it hits; those are merged by the hash of the text and joined, so hits are always judged on the input.
    """
    spark = documents.sparkSession
    names = [free_name(documents.columns, n) for n in ("n_words", "hits", "items")]
    kinds = [T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())]
    added = [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]
    wide = T.StructType([*documents.schema.fields, *added])
    at = documents.columns.index("text")
    blocks, sets = _blocks(benchmark, width, block_bytes)
    if blocks == 1:
        return documents.mapInArrow(_hit_rows(spark.sparkContext.broadcast(next(sets)), at, tuple(names)), wide), names
    folder = _store.new_folder(spark, "hits")
    texts = documents.select(F.sha2("text", 256).alias("sha"), "text").filter("text is not null")
    schema = T.StructType([*texts.schema.fields, *(T.StructField(n, k) for n, k in zip(("n_words", "hits", "items"), kinds, strict=True))])
    for b, known in enumerate(sets):
        held = spark.sparkContext.broadcast(known)
        got = texts.mapInArrow(_hit_rows(held, 1, ("n_words", "hits", "items")), schema).filter(F.size("hits") > 0)
        _store.save(got.select("sha", "hits", "items").dropDuplicates(["sha"]), f"{folder}/block={b}")
        held.destroy()
    nothing = HashSet(pa.array([], pa.int64()), pa.array([], pa.string()), width)
    whole = documents.mapInArrow(_hit_rows(spark.sparkContext.broadcast(nothing), at, tuple(names)), wide)
    found = spark.read.schema("sha string, hits array<int>, items array<string>").parquet(*[f"{folder}/block={b}" for b in range(blocks)])
    merge = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    found = found.groupBy("sha").agg(merge("hits").alias("hits"), merge("items").alias("items"))  # a row per block at most
    key, row = free_name([*documents.columns, *names], "sha"), whole.drop(*names[1:])
    found = found.select(F.col("sha").alias(key), F.col("hits").alias(names[1]), F.col("items").alias(names[2]))
    met = row.withColumn(key, F.sha2("text", 256)).join(found, key, "left")
    none = [F.coalesce(F.col(n), F.array().cast(k)).alias(n) for n, k in zip(names[1:], kinds[1:], strict=True)]
    return met.select(*documents.columns, names[0], *none), names


def scan(documents: DataFrame, benchmark: DataFrame, keys: list[str], width: int = NGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of `documents`: keys, n_words, hits (indices of hit words) and items (matched item ids as strings).

    The benchmark is taken in blocks of about `block_bytes` of text, whatever their number with the same
    result; every hash hit is verified on the words.  Null or empty texts have no words; an item without an
    id hits like any other but is not named; no benchmark gives no hits.
    """
    got, (n_words, hits, items) = _with_hits(documents.select(*keys, "text"), benchmark, width, block_bytes)
    return got.select(*keys, F.col(n_words).alias("n_words"), F.col(hits).alias("hits"), F.col(items).alias("items"))


def _cut(at: int, hits_at: int):
    """Texts without their hit words and what stands between neighbouring ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(released(batches), at):
            column = batch.column(at)
            hits = batch.column(hits_at)
            some = np.flatnonzero(pc.list_value_length(hits).fill_null(0).to_numpy(zero_copy_only=False))
            texts = column.to_pylist()
            raw, offs = text_bytes(column.take(pa.array(some)))
            tok = tokenize(raw, offs, WORD)
            begin = np.searchsorted(tok.doc, np.arange(len(some) + 1))
            for k, d in enumerate(some.tolist()):
                words = begin[k] + np.asarray(hits[d].values)
                cut = runs(words - np.arange(len(words)))
                kept, last = [], int(offs[k])
                for a, b in zip(cut, np.append(cut[1:], len(words)), strict=True):
                    kept.append(raw[last : tok.start[words[a]]].tobytes())
                    last = int(tok.end[words[b - 1]])
                texts[d] = b"".join([*kept, raw[last : offs[k + 1]].tobytes()]).decode()
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))

    return run


def remove_spans(documents: DataFrame, benchmark: DataFrame, width: int = NGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with every hit word, and what stands between neighbouring ones, cut out of `text`.

    All hits are found on the input before anything is cut, so what a cut brings together is not matched
    again.  A row whose text has no hit stays as it is, null included; other columns are carried through
    whatever their names.
    """
    got, names = _with_hits(documents, benchmark, width, block_bytes)
    return got.mapInArrow(_cut(documents.columns.index("text"), got.columns.index(names[1])), got.schema).select(*documents.columns)


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = NGRAM) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    got = scan(documents, benchmark, ["doc_id"], width)
    return got.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def remove_documents(documents: DataFrame, benchmark: DataFrame, width: int = NGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, as they are, that hold no benchmark window; null and empty texts hold none."""
    got, names = _with_hits(documents, benchmark, width, block_bytes)
    return got.filter(F.size(names[1]) == 0).select(*documents.columns)
