"""Spelling variants: words at edit distance one, by a trie joined with itself, and the common form of each.

The vocabulary's trie is dealt out by prefixes.  Of two words at distance one, of m and m or m + 1 code points,
either the first m // 2 code points are equal or the last m - m // 2, so a word goes to its prefix in the trie of
words and to its suffix, as a prefix, in that of reversed words.  A task takes the subtrees of whole prefixes and
goes down them level by level with the sets of active nodes: with every node the others that its string can turn
into by one edit.  Where two of a set end a word, the pair is emitted.  A prefix of too many words is split by the
next code point: the pairs whose edit is at that place meet by the rest of the word, the others one level down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import _store

#: Maximal runs of these are words.
RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_CHARS, LEAST_COUNT = 5, 3
#: A word is a variant of a near one that occurs so many times as often.
MORE = 2
#: Words of a prefix that one task takes.
BUCKET = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CHAR = np.int64(1 << 21)


def vocabulary(documents: DataFrame, slip: int = 97, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, those of enough code points that occur often enough.

    A run loses a code point where `slip` divides the crc32 of `<doc_id>:<run>` (0: nowhere).  Null texts have none;
    a row without doc_id loses nothing.
    """
    text = F.translate("text", _UPPER, _LOWER)
    runs = documents.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    word = F.col("run")
    if slip:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % slip == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    words = runs.select(word.alias("word")).filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def prefixes(words: DataFrame) -> DataFrame:
    """(m, back, key, rest, word, n): each word by prefix and by reversed suffix, for pairs with m as the lesser length."""
    size = F.length("word")
    of = F.explode(F.array(size, size - 1)).alias("m")
    lens = words.select("word", "n", of).withColumn("p", F.floor(F.col("m") / 2).cast("int"))
    mirrored = F.reverse(F.col("word"))
    ahead = F.struct(F.lit(False).alias("back"), F.substring("word", F.lit(1), F.col("p")).alias("key"), F.substring("word", F.col("p") + 1, size).alias("rest"))
    back = F.struct(F.lit(True).alias("back"), F.substring(mirrored, F.lit(1), F.col("m") - F.col("p")).alias("key"), F.substring(mirrored, F.col("m") - F.col("p") + 1, size).alias("rest"))
    return lens.select("m", F.explode(F.array(ahead, back)).alias("k"), "word", "n").select("m", "k.back", "k.key", "k.rest", "word", "n")


def _children(pairs: tuple[np.ndarray, np.ndarray], left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children, by the same code point, of pairs of nodes; each side's children as (parents, code points) in order."""
    begin = np.searchsorted(left[0], pairs[0])
    many = np.searchsorted(left[0], pairs[0], side="right") - begin
    child = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
    wanted = np.repeat(pairs[1], many) * _CHAR + left[1][child]
    keys = right[0] * _CHAR + right[1]
    place = np.searchsorted(keys, wanted)
    found = place < len(keys)
    found[found] = keys[place[found]] == wanted[found]
    return child[found], place[found]


def _siblings(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of one node; there are no more children than letters."""
    last = np.searchsorted(parent, parent, side="right")
    own = np.arange(len(parent))
    many = last - own - 1
    first = np.repeat(own, many)
    return first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)


def near_pairs(group: np.ndarray, rests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of strings of one group at distance one, each once; they come by group and in order, all different."""
    size = np.array([len(r) for r in rests], np.int64)
    text = np.frombuffer("".join(rests).encode("utf-32-le"), np.uint32).astype(np.int64)
    begin = np.cumsum(size) - size
    node = np.unique(group, return_inverse=True)[1].astype(np.int64)
    none = (np.empty(0, np.int64), np.empty(0, np.int64))
    alive, level, up, same, longer, out = np.arange(len(rests)), 0, none, none, none, [none]

    def emit(pairs: tuple[np.ndarray, np.ndarray], left: np.ndarray, right: np.ndarray) -> None:
        a, b = left[pairs[0]], right[pairs[1]]
        both = (a >= 0) & (b >= 0)
        out.append((a[both], b[both]))

    while len(alive):
        # of this level's nodes: the string that ends there, and how many go through
        stop = size[alive] == level
        ends = np.full(int(node.max()) + 1, -1)
        ends[node[stop]] = alive[stop]
        emit(same, ends, ends)
        through = np.bincount(node)
        if not len(same[0]) and not len(longer[0]) and (through < 2).all():
            break
        alive, node = alive[~stop], node[~stop]
        char = text[begin[alive] + level]
        fresh = np.ones(len(alive), dtype=bool)
        fresh[1:] = (node[1:] != node[:-1]) | (char[1:] != char[:-1])
        below = (node[fresh], char[fresh])
        child = np.cumsum(fresh) - 1
        child_ends = np.full(len(below[0]), -1)
        last = size[alive] == level + 1
        child_ends[child[last]] = alive[last]
        # x at this level, y one below: what was so a level up and goes on alike, and a node with its own children
        on = _children(longer, up, below)
        on = tuple(s[below[0][on[1]] != on[0]] for s in on)
        own = np.flatnonzero(through[below[0]] > 1)
        longer = (np.concatenate([on[0], below[0][own]]), np.concatenate([on[1], own]))
        emit(longer, ends, child_ends)
        new = _siblings(below[0])
        went = _children(same, below, below)
        same = (np.concatenate([went[0], new[0]]), np.concatenate([went[1], new[1]]))
        up, node, level = below, child, level + 1
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


_PAIRS = "m int, back boolean, word string, n long, near string, near_n long"


def _join_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solve(rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, checks = rows.column("gid").to_numpy(), rows.column("check").to_numpy()
        group = np.cumsum(np.append(False, (ids[1:] != ids[:-1]) | (checks[1:] != checks[:-1])))
        a, b = near_pairs(group, rows.column("rest").to_pylist())
        size = pc.utf8_length(rows.column("word")).to_numpy()
        m = rows.column("m").to_numpy()[a]
        some = np.minimum(size[a], size[b]) == m
        a, b = pa.array(a[some]), pa.array(b[some])
        take = lambda name, i: rows.column(name).take(i)
        return pa.RecordBatch.from_arrays([take("m", a), take("back", a), take("word", a), take("n", a), take("word", b), take("n", b)], names=["m", "back", "word", "n", "near", "near_n"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, BUCKET):
            held.append(batch.slice(lo, BUCKET))
            if sum(h.num_rows for h in held) < BUCKET:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            gid = rows.column("gid").to_numpy()
            cut = int(np.flatnonzero(gid != gid[-1])[-1]) + 1 if gid[0] != gid[-1] else 0
            if cut:
                yield solve(rows.slice(0, cut))
            held = [rows.slice(cut)]
    if held:
        yield solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _at_this_place(big: DataFrame) -> DataFrame:
    """Pairs of a split prefix whose edit is at the first place after it: equal from there on, by the rest of the word."""
    kind = ["m", "back", "key"]
    tail = F.substring("rest", F.lit(2), F.length("rest"))
    cut = big.filter(F.length("rest") > 0).select(*kind, F.length("word").alias("size"), tail.alias("tail"), F.substring("rest", 1, 1).alias("c"), "word", "n")
    other = cut.select(*kind, "size", "tail", F.col("c").alias("d"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    changed = cut.filter(F.col("size") == F.col("m")).join(other, [*kind, "size", "tail"]).filter(F.col("c") < F.col("d"))
    long = other.filter(F.col("size") == F.col("m") + 1).drop("size")
    short = big.filter(F.length("word") == F.col("m")).select(*kind, F.col("rest").alias("tail"), F.substring("rest", 1, 1).alias("c"), "word", "n")
    added = short.join(long, [*kind, "tail"]).filter(F.col("c") != F.col("d"))
    cols = ["m", "back", "word", "n", "near", "near_n"]
    return changed.select(*cols).unionByName(added.select(*cols))


def pairs_at_one(words: DataFrame, bucket: int = BUCKET, folder: str | None = None) -> DataFrame:
    """(word, n, near, near_n): all pairs of different words of a table (word, n) at edit distance one, each once.

    Words have two code points at least and are all different; an insertion, a deletion or a replacement is one edit.
    """
    spark = words.sparkSession
    folder = folder or _store.new_folder(spark, "variants")
    kind, found = ["m", "back", "key"], []
    todo = prefixes(words)
    for depth in range(1 << 30):
        todo = _store.save(todo, f"{folder}/prefixes{depth}")
        hot = _store.save(todo.groupBy(*kind).agg(F.count("*").alias("size")).filter(F.col("size") > bucket).select(*kind), f"{folder}/hot{depth}")
        if hot.isEmpty():
            found.append(todo)
            break
        hot = _store.light(hot)
        found.append(todo.join(hot, kind, "left_anti"))
        big = todo.join(hot, kind, "left_semi")
        found.append(_at_this_place(big))
        c = F.substring("rest", 1, 1)
        todo = big.filter(F.length("rest") > 0).select("m", "back", F.concat("key", c).alias("key"), F.substring("rest", F.lit(2), F.length("rest")).alias("rest"), "word", "n")
    out = None
    for part in found:
        if "rest" in part.columns:
            part = part.select(F.xxhash64(*kind).alias("gid"), F.crc32(F.col("key").cast("binary")).alias("check"), "m", "back", "rest", "word", "n")
            part = part.repartition("gid").sortWithinPartitions("gid", "m", "back", "check", "rest").mapInArrow(_join_subtrees, _PAIRS)
        out = part if out is None else out.unionByName(part)
    half = F.floor(F.col("m") / 2).cast("int")
    twice = F.col("back") & (F.substring("word", F.lit(1), half) == F.substring("near", F.lit(1), half))
    return out.filter(~twice).select("word", "n", "near", "near_n")


def forms(words: DataFrame, bucket: int = BUCKET, more: int = MORE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a table (word, n) of different words.

    n_near counts the words at distance one; `form` is that of the largest n, ties by code points, if it has `more`
    times the word's, else null; `root` is where the forms of forms end, the word itself without one.
    """
    spark = words.sparkSession
    folder = _store.new_folder(spark, "variants")
    words = _store.save(words.select("word", "n"), f"{folder}/words")
    pairs = pairs_at_one(words, bucket, folder)
    both = F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("x")
    near = pairs.select(both).groupBy("x.word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("x.near_n")).alias("less"), F.col("x.near").alias("near"))).alias("best"))
    all_ = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    follows = F.coalesce(F.col("form_n") >= more * F.col("n"), F.lit(False))
    all_ = _store.save(all_.withColumns({"form": F.when(follows, F.col("form")), "form_n": F.when(follows, F.col("form_n"))}), f"{folder}/forms")
    # each n is `more` times the one before, so chains are short: every round doubles the steps that are taken
    ends = _store.save(all_.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), f"{folder}/ends0")
    for depth in range(1, 1 << 30):
        nxt = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = _store.save(ends.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"{folder}/ends{depth}")
        moved = not ends.filter("moved").isEmpty()
        ends = ends.drop("moved")
        if not moved:
            break
    return all_.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(documents: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(word, form, root, n, n_near, form_n) over the vocabulary of all whole texts; see `vocabulary` and `forms`.

    Rows that occur twice count twice.  An empty table, or one of null texts, gives no rows.
    """
    return forms(vocabulary(documents), bucket).select("word", "form", "root", "n", "n_near", "form_n")
