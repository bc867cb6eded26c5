"""Pairs of rows by vector, BM25 and hybrid similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import bm25_tokens

BLOCK = 1024
K1, B, LEAST_IDF = 1.5, 0.75, 0.25
SEMANTIC, LEXICAL, EXACT_FLOOR, EXACT_GUARD = 0.6, 0.4, 0.85, 0.5


def by_blocks(solve: Callable[[pa.Table], Iterator[pa.RecordBatch]], keys: tuple[str, ...] = ("kind", "left", "right")):
    """Over rows in order of `keys`: what `solve` makes of the rows of each two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and marks[lo] != now:
                    yield from solve(pa.Table.from_batches(held).combine_chunks())
                    held = []
                now = marks[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return run


def _block_pairs(low: float, high: float | None, digits: int, best: int | None = None):
    unit = 10.0**-digits

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        left, right = rows.column("left")[0].as_py(), rows.column("right")[0].as_py()
        block, ids = rows.column("block").to_numpy(), rows.column("id").to_numpy()
        vectors = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        np.divide(vectors, size, out=vectors, where=size > 0)
        a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
        score = vectors[a] @ vectors[b].T
        keep = score >= low - unit
        if high is not None:
            keep &= score < high + unit
        if left == right:
            keep &= np.triu(np.ones(keep.shape, dtype=bool), 1)
        i, j = np.nonzero(keep)
        # the score that is given is the one that counts
        given = np.round(score[i, j], digits)
        sure = (given >= low) & (given < (np.inf if high is None else high))
        i, j, given = i[sure], j[sure], given[sure]
        if not len(i):
            return
        x, y = ids[a[i]], ids[b[j]]
        swap = x > y
        kind, key = rows.schema.field("kind").type, rows.schema.field("id").type
        first, second = np.where(swap, y, x), np.where(swap, x, y)
        if best is not None and len(i) > best:
            order = np.lexsort((second, first, -given))[:best]
            i, first, second, given = i[order], first[order], second[order], given[order]
        yield pa.RecordBatch.from_arrays(
            [rows.column("kind").combine_chunks().take(pa.array(np.zeros(len(i), np.int64))).cast(kind), pa.array(first, key), pa.array(second, key), pa.array(given)],
            names=["kind", "a", "b", "score"],
        )

    return by_blocks(solve)


def similar_pairs(rows: DataFrame, low: float, high: float | None = None, kind: str | None = None, key: str = "id", vector: str = "vector", block: int = BLOCK, digits: int = 6, fresh: str | None = None, best: int | None = None) -> DataFrame:
    """(kind, a, b, score): all pairs a < b of one kind whose cosine, rounded to `digits`, is at least `low` (and below `high`).

    Rows of a kind are dealt into blocks of about `block`, and each two blocks meet in one task as a
    matrix product: every pair is compared, only those that count leave the task, and a large kind is
    spread over as many tasks as it has pairs of blocks.  NULL keys and vectors are left out; of rows of one
    kind and key the least vector counts.  With `fresh`, a boolean column, only pairs that hold a fresh row are
    looked for: blocks without one do not meet.  With `best` each two blocks give only so many pairs, the best as in
    `top_pairs`: enough for the best of all, and no more than that leaves a task.
    """
    base = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull())
    new = F.col(fresh) if fresh else F.lit(True)
    base = base.select((F.col(kind) if kind else F.lit(0)).alias("kind"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"), new.alias("fresh"))
    base = base.groupBy("kind", "id").agg(F.min("vector").alias("vector"), F.max("fresh").alias("fresh"))
    blocks = lambda of: F.ceil(F.count_if(of) / block).cast("int")
    size = base.groupBy(F.col("kind").alias("_kind")).agg(blocks(~F.col("fresh")).alias("old"), blocks(F.col("fresh")).alias("new"))
    placed = base.join(size, F.col("kind").eqNullSafe(F.col("_kind"))).filter("new > 0")
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    placed = placed.withColumn("block", F.when(F.col("fresh"), F.col("old") + dealt("new")).otherwise(dealt("old")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.when(F.col("fresh"), 0).otherwise(F.col("old")), F.col("old") + F.col("new") - 1)))
    met = placed.select("kind", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "id", "vector")
    types = {f.name: f.dataType.simpleString() for f in met.schema}
    dealt = met.repartition("kind", "left", "right").sortWithinPartitions("kind", "left", "right", "id")
    return dealt.mapInArrow(_block_pairs(low, high, digits, best), f"kind {types['kind']}, a {types['id']}, b {types['id']}, score double")


def top_pairs(pairs: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """The k best pairs, over all or for each value of `by`; ties by a, then b."""
    order = [F.desc("score"), F.col("a"), F.col("b")]
    if by is None:
        return pairs.orderBy(*order).limit(k)
    ranked = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col("_n") <= k).drop("_n")


def _bm25_rows(names: DataFrame, key: str, name: str, kind: str | None) -> DataFrame:
    return names.select((F.col(kind) if kind else F.lit(0)).alias("_kind"), F.col(key).alias("_id"), bm25_tokens(F.col(name)).alias("_words"))


def _bm25_corpus(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((kind, term, df, idf), (kind, n, avgdl)) over all rows of each kind; idf has a floor."""
    size = rows.groupBy("_kind").agg(F.count("*").alias("n"), F.avg(F.size("_words")).alias("avgdl"))
    df = rows.select("_kind", F.explode(F.array_distinct("_words")).alias("term")).groupBy("_kind", "term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return df.join(size, "_kind").select("_kind", "term", "df", F.greatest(idf, F.lit(LEAST_IDF)).alias("idf")), size


def bm25_stats(names: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """(term, df, idf): document frequency and floored idf of each term over all names."""
    return _bm25_corpus(_bm25_rows(names, key, name, None))[0].drop("_kind")


def bm25_scores(names: DataFrame, queries: DataFrame, key: str = "id", name: str = "name", kind: str | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """(query, key, score) of all queries and names of a kind that share a term, each query's best score being 1.

    Statistics are those of `corpus` (default: the names).  Repeated words of a query count as often as
    they occur.  What a common term brings is summed on the map side first.
    """
    rows, asked = _bm25_rows(names, key, name, kind), _bm25_rows(queries, key, name, kind)
    stats, size = _bm25_corpus(rows if corpus is None else _bm25_rows(corpus, key, name, kind))
    count = lambda r: r.select("_kind", "_id", F.size("_words").alias("dl"), F.explode("_words").alias("term")).groupBy("_kind", "_id", "dl", "term").agg(F.count("*").alias("tf"))
    share = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weight = count(rows).join(stats, ["_kind", "term"]).join(size, "_kind").select("_kind", "term", F.col("_id").alias(key), share.alias("w"))
    times = count(asked).select("_kind", "term", F.col("_id").alias("query"), F.col("tf").alias("times"))
    raw = times.join(weight, ["_kind", "term"]).groupBy("query", key).agg(F.sum(F.col("times") * F.col("w")).alias("s"))
    most = raw.groupBy("query").agg(F.max("s").alias("most"))
    return raw.join(most, "query").select("query", key, F.when(F.col("most") > 0, F.col("s") / F.col("most")).otherwise(0.0).alias("score"))


def bm25_pairwise(names: DataFrame, key: str = "id", name: str = "name", kind: str | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """(a, b, score), a < b: the mean of both directions' scores, for names of a kind that share a term."""
    s = bm25_scores(names, names, key, name, kind, corpus)
    both = s.filter(F.col("query") != F.col(key)).select(F.least("query", key).alias("a"), F.greatest("query", key).alias("b"), "score")
    return both.groupBy("a", "b").agg((F.sum("score") / 2).alias("score"))


def hybrid(cosine: Column, lexical: Column, same_key: Column, semantic_weight: float = SEMANTIC, lexical_weight: float = LEXICAL) -> Column:
    """Weighted mean of both scores; names of one match key that are not unlike in meaning score EXACT_FLOOR at least."""
    total = semantic_weight + lexical_weight
    score = cosine * (semantic_weight / total) + F.coalesce(lexical, F.lit(0.0)) * (lexical_weight / total)
    return F.when(same_key & (cosine >= EXACT_GUARD), F.greatest(score, F.lit(EXACT_FLOOR))).otherwise(score)


def greedy_leaders(items: DataFrame, pairs: DataFrame, key: str = "id", group: str = "group", pos: str = "pos") -> DataFrame:
    """(group, key, kept): scanning in order, a row that none kept before is linked to is kept.

    Rounds decide many rows at once: a row whose earlier linked rows are all removed is kept; a row
    linked to an earlier kept one is removed.  Links are pairs (a, b) of keys, in either order.
    """
    from loomgraph.operators.rounds import settle

    state = settle(items.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(pos).alias("p"), F.lit(None).cast("boolean").alias("kept")))
    both = pairs.select(F.col("a").alias("k"), F.col("b").alias("o")).union(pairs.select("b", "a"))
    at = state.select("g", "k", "p")
    earlier = both.join(at, "k").join(at.select(F.col("g").alias("og"), F.col("k").alias("o"), F.col("p").alias("op")), "o")
    earlier = settle(earlier.filter("g <=> og and op < p").select("k", "o").distinct())
    while True:
        known = earlier.join(state.select(F.col("k").alias("o"), F.col("kept").alias("okept")), "o")
        seen = known.groupBy("k").agg(F.bool_or("okept").alias("covered"), F.bool_and(F.coalesce(~F.col("okept"), F.lit(False))).alias("free"))
        state = settle(
            state.join(seen, "k", "left").select(
                "g", "k", "p", F.coalesce("kept", F.when(F.col("covered"), False).when(F.coalesce("free", F.lit(True)), True)).alias("kept")
            )
        )
        if not state.filter("kept is null").take(1):
            return state.select(F.col("g").alias(group), F.col("k").alias(key), "kept")


#: Rows of a group that are decided one after another in a round, and of a block that is held against those kept.
HEADS, SLICE = 16384, 512


def _units(rows: pa.Table) -> np.ndarray:
    vectors = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1).astype(np.float64)
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=vectors, where=size > 0)


def _near(a: np.ndarray, b: np.ndarray, low: float, digits: int) -> np.ndarray:
    """Which scores, as they are given, reach `low`."""
    score = a @ b.T
    near = score >= low - 10.0**-digits
    near[near] = np.round(score[near], digits) >= low
    return near


def _scanned(low: float, digits: int):
    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """A group's rows in order, with whether each is kept."""
        unit = _units(rows)
        leads, kept, n = np.empty_like(unit), np.zeros(len(unit), dtype=bool), 0
        for lo in range(0, len(unit), SLICE):
            part = unit[lo : lo + SLICE]
            covered, own = _near(part, leads[:n], low, digits).any(axis=1), _near(part, part, low, digits)
            for i in range(len(part)):
                if not covered[i]:
                    kept[lo + i] = True
                    leads[n] = part[i]
                    n += 1
                    covered |= own[i]
        yield from rows.append_column("kept", pa.array(kept)).to_batches()

    return solve


def _held_against(low: float, digits: int):
    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """A block's open rows, with whether one of those kept is near."""
        unit, lead = _units(rows), rows.column("lead").to_numpy()
        leads, open_ = unit[lead], np.flatnonzero(~lead)
        covered = np.zeros(len(open_), dtype=bool)
        for lo in range(0, len(open_), SLICE):
            covered[lo : lo + SLICE] = _near(unit[open_[lo : lo + SLICE]], leads, low, digits).any(axis=1)
        yield from rows.take(pa.array(open_)).select(["kind", "id", "p", "vector"]).append_column("covered", pa.array(covered)).to_batches()

    return solve


def greedy_by_vector(items: DataFrame, low: float, key: str = "id", group: str = "group", pos: str = "pos", vector: str = "vector", digits: int = 6, heads: int | None = None) -> DataFrame:
    """(group, key, kept): scanning in order, a row is kept whose cosine, rounded, is below `low` with all kept before it.

    As `greedy_leaders` over `similar_pairs`, but no pairs are made.  A round scans the next `heads` rows of each group
    in one task, then holds the group's other rows, in blocks, against those that were kept and lets go of what is near.
    So a round moves each open row once, and what is kept once to each block.  Keys are different, and settle equal places;
    rows without key or vector are like none and kept.
    """
    from loomgraph.operators.rounds import settle, stored

    heads = heads or HEADS
    rows = items.select(F.col(group).alias("kind"), F.col(key).alias("id"), F.col(pos).alias("p"), F.col(vector).cast("array<double>").alias("vector"))
    usable = F.col("id").isNotNull() & F.col("vector").isNotNull()
    done, open_ = rows.filter(~usable).select("kind", "id", F.lit(True).alias("kept")), stored(rows.filter(usable), "open")
    types = dict(rows.dtypes)
    shape = ", ".join(f"{c} {types[c]}" for c in ("kind", "id", "p", "vector"))
    of_kind = F.col("kind").eqNullSafe(F.col("_kind"))
    while open_.take(1):
        place = open_.select("kind", F.struct("p", "id").alias("_at")).withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy("_at"))).filter(F.col("_n") <= heads)
        cut = settle(place.groupBy(F.col("kind").alias("_kind")).agg(F.max("_at").alias("_cut")))
        marked = open_.join(cut, of_kind).withColumn("_first", F.struct("p", "id") <= F.col("_cut"))
        first = marked.filter("_first").select("kind", "id", "p", "vector").repartition("kind").sortWithinPartitions("kind", "p", "id")
        scanned = stored(first.mapInArrow(by_blocks(_scanned(low, digits), ("kind",)), f"{shape}, kept boolean"), "scanned")
        rest = marked.filter("not _first").select("kind", "id", "p", "vector")
        size = rest.groupBy(F.col("kind").alias("_kind")).agg(F.ceil(F.count("*") / heads).cast("int").alias("_blocks"))
        asked = rest.join(size, of_kind).select("kind", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int").alias("block"), "id", "p", "vector", F.lit(False).alias("lead"))
        told = scanned.filter("kept").join(size, of_kind).select("kind", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"), "id", "p", "vector", F.lit(True).alias("lead"))
        met = asked.unionByName(told).repartition("kind", "block").sortWithinPartitions("kind", "block")
        held = stored(met.mapInArrow(by_blocks(_held_against(low, digits), ("kind", "block")), f"{shape}, covered boolean"), "against")
        done = done.unionByName(scanned.select("kind", "id", "kept")).unionByName(held.filter("covered").select("kind", "id", F.lit(False).alias("kept")))
        open_ = held.filter("not covered").select("kind", "id", "p", "vector")
    return done.select(F.col("kind").alias(group), F.col("id").alias(key), "kept")


#: Rows that ask in one task, and those of a tile of scores.
ASKING, ASKED_TILE = 65536, 4096
#: What scores of single precision may be off.
COARSE = 1e-5


class _Asking:
    """Rows of a block with the best held row that each has met so far."""

    def __init__(self, rows: pa.Table) -> None:
        self.unit, self.ids, self.place = _units(rows), rows.column("id").combine_chunks(), rows.column("place").to_numpy()
        self.coarse = self.unit.astype(np.float32)
        self.score, self.best = np.full(len(self.ids), -np.inf), np.full(len(self.ids), None, dtype=object)

    def meet(self, rows: pa.Table, low: float, digits: int) -> None:
        """Held rows, in order, take the place of worse ones."""
        held, ids, place = _units(rows), rows.column("id").combine_chunks(), rows.column("place").to_numpy()
        for begin in range(0, len(held), SLICE):
            other = held[begin : begin + SLICE].astype(np.float32).T.copy()
            for lo in range(0, len(self.coarse), ASKED_TILE):
                i, j = np.nonzero(self.coarse[lo : lo + ASKED_TILE] @ other >= low - COARSE)
                i, j = i + lo, j + begin
                for k in range(0, len(i), 65536):
                    self._take(i[k : k + 65536], j[k : k + 65536], held, ids, place, low, digits)

    def _take(self, i: np.ndarray, j: np.ndarray, held: np.ndarray, ids: pa.Array, place: np.ndarray, low: float, digits: int) -> None:
        score = np.einsum("ij,ij->i", self.unit[i], held[j])
        sure = (np.round(score, digits) >= low) & (place[j] <= self.place[i])
        for k in np.flatnonzero(sure & (place[j] == self.place[i])):
            sure[k] = ids[int(j[k])].as_py() < self.ids[int(i[k])].as_py()
        i, j, score = i[sure], j[sure], np.round(score[sure], 9)
        order = np.lexsort((j, -score, i))
        first = order[np.diff(i[order], prepend=-1) > 0]
        better = first[score[first] > self.score[i[first]]]
        self.score[i[better]] = score[better]
        self.best[i[better]] = ids.take(pa.array(j[better])).to_pylist()

    def told(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(some)), pa.array(self.best[some].tolist(), self.ids.type), pa.array(self.score[some])], names=["id", "best", "score"])


def _nearest_held(low: float, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over rows in order of kind and block, those that ask first: the best held row of each."""
        now, waiting, asking = None, [], None
        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "held")), strict=True))
            cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                part, (*group, held) = batch.slice(lo, hi - lo), marks[lo]
                if group != now:
                    if asking:
                        yield asking.told()
                    now, waiting, asking = group, [], None
                if not held:
                    waiting.append(part)
                elif asking or waiting:
                    if not asking:
                        asking, waiting = _Asking(pa.Table.from_batches(waiting)), []
                    asking.meet(pa.Table.from_batches([part]), low, digits)
        if asking:
            yield asking.told()

    return run


def nearest(asked: DataFrame, held: DataFrame, low: float, digits: int = 12, most: int | None = None) -> DataFrame:
    """(id, best, score) of asked rows (kind, id, vector, place): the held row (kind, id, vector, place, at) of their kind with the highest cosine, in nine places, the first of equals by `at`, if the cosine reaches `low`.

    Only held rows of a smaller `place`, a whole number, count, of equal places those of smaller ids.  Asked rows are dealt into blocks of about `most`, which
    held rows stream past in their order: an asked row moves once, a held one once to each block, and no pairs are made.
    """
    n = F.count("*")
    # few rows are dealt to several tasks as well
    size = asked.groupBy(F.col("kind").alias("_kind")).agg(F.greatest(F.ceil(n / (most or ASKING)), F.least(F.lit(8), F.ceil(n / BLOCK))).cast("int").alias("_blocks"))
    of_kind = F.col("kind").eqNullSafe(F.col("_kind"))
    at = dict(held.dtypes)["at"]
    ask = asked.join(size, of_kind).select("kind", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int").alias("block"), F.lit(False).alias("held"), F.lit(None).cast(at).alias("at"), "id", "vector", F.col("place").cast("long").alias("place"))
    told = held.join(size, of_kind).select("kind", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"), F.lit(True).alias("held"), "at", "id", "vector", F.col("place").cast("long").alias("place"))
    met = ask.unionByName(told).repartition("kind", "block").sortWithinPartitions("kind", "block", "held", "at").select("kind", "block", "held", "id", "vector", "place")
    type_ = dict(met.dtypes)["id"]
    return met.mapInArrow(_nearest_held(low, digits), f"id {type_}, best {type_}, score double")
