"""Many words looked up in many texts: one pass of an automaton over each text, whatever the number of words.

Words and texts belong to scopes (an event, say).  The words of a scope are dealt into blocks of a bounded size,
each an automaton in memory; its texts are dealt into stretches, so a scope that holds a third of all texts
spreads over many tasks.  Every stretch meets every block: texts are streamed through, nothing else is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the words of one automaton, and of the texts of a stretch.
BLOCK_BYTES, STRETCH_BYTES = 4 << 20, 16 << 20


def automaton(words: list[str], values: list):
    """An automaton over different words that are not empty."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, value in zip(words, values, strict=True):
        found.add_word(word, value)
    found.make_automaton()
    return found


def _looked_up(any_: bool, key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, built, out = None, [], None, ([], [])

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(out[0], key_type), pa.array(out[1], pa.string())], names=["key", "word"])
            out[0].clear()
            out[1].clear()
            return rows

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("place", "is_text", "key", "text"))
            for place, is_text, key, text in zip(*columns, strict=True):
                if place != now:
                    now, words, built = place, [], None
                if not is_text:
                    words.append(text)
                    continue
                if built is None:
                    full = [w for w in dict.fromkeys(words) if w]
                    built = (automaton(full, full) if full else None, "" in words)
                machine, empty = built
                hits = machine.iter(text) if machine else iter(())
                if any_:
                    some = [""] if empty else [w for _, w in [next(hits, (0, None))] if w is not None]
                else:
                    some = sorted({w for _, w in hits} | ({""} if empty else set()))
                out[0].extend([key] * len(some))
                out[1].extend(some)
                if len(out[0]) >= 10_000:
                    yield flush()
        if out[0]:
            yield flush()

    return run


def found_words(texts: DataFrame, words: DataFrame, scope: str, key: str, text: str, word: str, any_: bool = False, block_bytes: int = BLOCK_BYTES, stretch_bytes: int = STRETCH_BYTES) -> DataFrame:
    """(key, word): the different words of a text's scope that it holds anywhere, as they are; with `any_` at most one of a block.

    Null texts, words and scopes are left out; an empty word is held by every text of its scope.
    """
    rows = texts.select(F.col(scope).alias("scope"), F.col(key).alias("key"), F.col(text).alias("text")).filter("scope is not null and text is not null")
    own = words.select(F.col(scope).alias("scope"), F.col(word).alias("text")).filter("scope is not null and text is not null").distinct()
    size = lambda df, limit, name: df.groupBy("scope").agg(F.floor(F.sum(F.octet_length("text") + 1) / limit + 1).cast("int").alias(name))
    sizes = size(rows, stretch_bytes, "stretches").join(size(own, block_bytes, "blocks"), "scope")
    deal = lambda value, n: F.pmod(F.xxhash64(value), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kind = rows.schema["key"].dataType
    asked = own.join(sizes, "scope").withColumn("block", deal("text", "blocks")).withColumn("stretch", each("stretches")).select("scope", "block", "stretch", F.lit(False).alias("is_text"), F.lit(None).cast(kind).alias("key"), "text")
    # rows of a hot scope share their key with few others: the text's own hash deals them out
    dealt = rows.join(sizes, "scope").withColumn("stretch", F.pmod(F.xxhash64("key", "text"), F.col("stretches")).cast("int")).withColumn("block", each("blocks")).select("scope", "block", "stretch", F.lit(True).alias("is_text"), "key", "text")
    met = asked.unionByName(dealt).withColumn("place", F.concat_ws("|", F.col("scope").cast("string"), "block", "stretch")).select("place", "is_text", "key", "text")
    met = met.repartition("place").sortWithinPartitions("place", "is_text")
    schema = T.StructType([T.StructField("key", kind), T.StructField("word", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_type

    return met.mapInArrow(_looked_up(any_, to_arrow_type(kind)), schema)


def first_rule(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The code of the first rule, in order, of which a text holds a keyword; NULL if none does.  One pass over the text.

    `rules` are a parameter and go to every task; of a keyword of several rules the first counts.
    """
    rank: dict[str, int] = {}
    for i, (_, words) in enumerate(rules):
        for w in words:
            rank.setdefault(w, i)
    codes, always = [code for code, _ in rules], rank.pop("", None)

    @F.pandas_udf("string")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = automaton(list(rank), list(rank.values())) if rank else None

        def of(value: str | None) -> str | None:
            best = len(codes) if always is None or value is None else always
            for _, i in machine.iter(value) if machine and value is not None else ():
                if i < best:
                    best = i
                    if not best:
                        break
            return codes[best] if best < len(codes) else None

        for values in batches:
            yield values.map(of, na_action=None).astype(object).where(lambda s: s.notna(), None)

    return code(text)
