"""Quality classifier: a generalised additive model with pairwise interactions, learnt by cyclic boosting.

Each text becomes a row of surface features.  Every feature has a lookup table over its bins, and some
pairs of features have a two-way one; tables are sums of shallow trees, boosted in turn.  A score is the
logistic of a sum of table entries, taken for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm._store import free_name
from loomgraph.llm._text import VISIBLE, pieces, released, runs, text_bytes, tokenize

#: Most labelled rows to learn from, chosen by a hash of doc_id: a bound on what reaches the driver.
MAX_LABELLED = 20_000
THRESHOLD = 0.7
BLOCK = 40

FEATURES = (
    "log_words", "mean_word", "long_words", "upper", "symbols", "digits", "distinct_words", "top_word",
    "repeats", "repeated_lines", "words_per_line", "stops_per_word", "lone_symbols", "word_ends",
    "block_upper", "block_symbols", "block_repeats", "block_lone", "block_distinct", "log_longest_word",
)

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"()-?"]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".?!"]] = True
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text; the `block_` ones are the worst of its stretches of BLOCK words."""
    n = len(offsets) - 1
    tok = tokenize(raw, offsets, VISIBLE)
    count = np.maximum(tok.per_doc(), 1)
    size = np.maximum(np.diff(offsets), 1)
    begin = np.searchsorted(tok.doc, np.arange(n + 1))

    def within(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marked bytes of each text, and of each word."""
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(mask[raw], out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]], total[tok.end] - total[tok.start]

    per_text = lambda values: np.bincount(tok.doc, weights=values, minlength=n)
    length = tok.end - tok.start
    upper, upper_w = within(_UPPER)
    symbols, symbols_w = within(_SYMBOL)
    digits, _ = within(_DIGIT)
    stops, _ = within(_STOP)
    repeat = np.zeros(len(tok.hash), dtype=bool)
    repeat[1:] = (tok.hash[1:] == tok.hash[:-1]) & (tok.doc[1:] == tok.doc[:-1])
    lone = symbols_w == length
    tail = _SYMBOL[tok.data[tok.end - 1]] if len(tok.end) else np.empty(0, dtype=bool)

    order = np.lexsort((tok.hash, tok.doc))
    same_doc, same_hash = tok.doc[order], tok.hash[order]
    first = runs(same_hash ^ (same_doc.astype(np.uint64) << np.uint64(40)))
    distinct = np.bincount(same_doc[first], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, same_doc[first], np.diff(np.append(first, len(order))))

    lines = tokenize(raw, offsets, _LINE, lower=False)
    order = np.lexsort((lines.hash, lines.doc))
    first = runs(lines.hash[order] ^ (lines.doc[order].astype(np.uint64) << np.uint64(40)))
    n_lines = np.maximum(lines.per_doc(), 1)
    distinct_lines = np.bincount(lines.doc[order][first], minlength=n)

    block = begin[tok.doc]
    block = (np.arange(len(tok.hash)) - block) // BLOCK
    key = runs(tok.doc * (1 << 32) + block)
    worst = np.zeros((5, n))
    if len(key):
        of = tok.doc[key]
        ends = np.append(key[1:], len(tok.hash))
        words = ends - key
        sums = lambda v: np.add.reduceat(v.astype(np.float64), key)
        letters = np.maximum(sums(length), 1)
        full = np.where(words >= BLOCK // 2, 1.0, 0.0)
        whole = count[of] < BLOCK // 2
        weight = np.maximum(full, whole)
        number = np.repeat(np.arange(len(key)), words)
        order = np.lexsort((tok.hash, number))
        fresh = runs(tok.hash[order] ^ (number[order].astype(np.uint64) << np.uint64(32)))
        kinds = np.bincount(number[order][fresh], minlength=len(key))
        for row, value in enumerate((sums(upper_w) / letters, sums(symbols_w) / letters, sums(repeat) / words, sums(lone) / words, 1 - kinds / words)):
            np.maximum.at(worst[row], of, value * weight)
    longest = np.zeros(n)
    np.maximum.at(longest, tok.doc, length)
    return np.stack(
        [
            np.log1p(tok.per_doc()),
            per_text(length) / count,
            per_text(length > 20) / count,
            upper / size,
            symbols / size,
            digits / size,
            distinct / count,
            top / count,
            per_text(repeat) / count,
            1 - distinct_lines / n_lines,
            np.log(count / n_lines),
            stops / count,
            per_text(lone) / count,
            per_text(tail) / count,
            *worst,
            np.log1p(longest),
        ],
        axis=1,
    )


@dataclass
class Additive:
    """Bin edges and tables of the model; `bias` alone scores if it was given one class only."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, edges_a, edges_b, table in self.pairs:
            total += table[np.searchsorted(edges_a, x[:, a], side="right"), np.searchsorted(edges_b, x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    distinct = np.unique(values)
    if len(distinct) <= 1:
        return np.empty(0)
    wanted = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf"))
    after = distinct[np.minimum(np.searchsorted(distinct, wanted, side="right"), len(distinct) - 1)]
    return np.unique((wanted + after) / 2)


REGULAR = 1.0
LEAST = 1.0


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return -g / (h + REGULAR)


def _gain(g, h):
    return g * g / (h + REGULAR)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Newton gain and place of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    value = np.where((hl >= LEAST) & (hr >= LEAST), _gain(gl, hl) + _gain(gr, hr) - _gain(g.sum(), h.sum()), 0.0)
    at = int(np.argmax(value))
    return float(value[at]), at + 1


def _stump3(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to three leaves over the bins of one feature."""
    cuts = [0, len(g)]
    for _ in range(2):
        best = max(((*_best_cut(g[a:b], h[a:b]), a) for a, b in zip(cuts, cuts[1:], strict=False)), key=lambda c: c[0])
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[2] + best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _tree4(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a two-level tree over a grid: rows are cut once, then each side's columns where that gains."""
    best: tuple[float, np.ndarray] = (0.0, np.zeros_like(g))
    whole = _gain(g.sum(), h.sum())
    for cut in range(1, len(g)):
        out, gain = np.zeros_like(g), -whole
        for rows in (slice(0, cut), slice(cut, None)):
            gs, hs = g[rows].sum(axis=0), h[rows].sum(axis=0)
            won, at = _best_cut(gs, hs)
            at = at if won > 0 else 0
            for cols in (slice(0, at), slice(at, None)):
                gain += _gain(gs[cols].sum(), hs[cols].sum())
                out[rows, cols] = _leaf(gs[cols].sum(), hs[cols].sum())
        if gain > best[0]:
            best = (float(gain), out)
    return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 120, rate: float = 0.15, n_pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 25) -> Additive:
    """Learn from features and 0/1 labels; the order of rows does not matter beyond rounding."""
    positive = float(y.sum())
    bias = float(np.log((positive + 1) / (len(y) - positive + 1)))
    if len(y) == 0 or positive in (0.0, float(len(y))):
        return Additive(bias)
    edges = [_edges(x[:, j], bins) for j in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), bias)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(tables):
            if len(table) == 1:
                continue
            g, h = slopes()
            tree = rate * _stump3(np.bincount(binned[j], g, len(table)), np.bincount(binned[j], h, len(table)))
            table += tree
            total += tree[binned[j]]
    g, h = slopes()
    coarse = [_edges(x[:, j], pair_bins) for j in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(cells[a] * shape[1] + cells[b], values, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((_tree4(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(len(edges)) for b in range(a + 1, len(edges)) if len(coarse[a]) and len(coarse[b])), reverse=True)
    chosen = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for gain, a, b in ranked[:n_pairs] if gain > 0]
    for _ in range(pair_rounds):
        for a, b, table in chosen:
            g, h = slopes()
            tree = rate * _tree4(grid(a, b, g), grid(a, b, h))[1]
            table += tree
            total += tree[cells[a], cells[b]]
    return Additive(bias, edges, tables, [(a, b, coarse[a], coarse[b], t) for a, b, t in chosen])


def held_out(doc_id) -> F.Column:
    """Rows kept from learning: crc32 of doc_id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(released(batches), "text"):
        x = features(*text_bytes(batch.column("text")))
        flat = pa.array(x.ravel())
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.FixedSizeListArray.from_arrays(flat, x.shape[1]).cast(pa.list_(pa.float64()))], names=["quality", "x"])


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Additive:
    """Learn from the labelled documents outside the held-out fold, `max_labelled` of them at most.

    Where there are more, those with the lowest hash of doc_id are taken.  Null labels and ids are left out.
    """
    rows = labels.select("doc_id", F.col("quality").cast("double").alias("quality")).filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
    rows = rows.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id", "quality").limit(max_labelled).drop("_h")
    texts = documents.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("quality", "text")
    got = texts.mapInArrow(_feature_rows, "quality double, x array<double>").toArrow()
    y = got.column("quality").to_numpy()
    x = np.array(got.column("x").combine_chunks().flatten().to_numpy()).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, y))
    return fit(x[order], (y[order] > 0).astype(float))


def _score(known, at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in pieces(released(batches), at):
            x = features(*text_bytes(batch.column(at)))
            found = np.where(x[:, 0] > 0, model.score(x), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, name])

    return run


def score(documents: DataFrame, model: Additive, name: str = "score") -> DataFrame:
    """The documents with a column `name`, 0 to 1.  An own column of that name is replaced.

    A text without words, null included, gets 0: nothing like it is ever labelled, so that the tables, which have
    no bins for it, would take it for the short and clean texts next to it.
    """
    rows = documents.drop(name)
    known = documents.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(known, rows.columns.index("text"), name), T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1: good)."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, as they are, whose score reaches the threshold; columns of any name are carried through."""
    name = free_name(documents.columns, "score")
    return score(documents, train(documents, labels), name).filter(F.col(name) >= threshold).drop(name)
