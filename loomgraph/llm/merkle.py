"""Merkle manifests of a dataset in SQL functions: a tree for each source, and one over the sources' roots.

Rows become leaves by their fields.  The leaves of a source, in order, are dealt into blocks of a fixed size, each
an array in one row; `sequence`, `transform`, `slice` and `aggregate` collapse its levels, runs of FAN nodes into
one.  The roots of a source's blocks are the leaves of the next round, until one is left.  A round reads a row for
each block of the one before, so rounds are few and each is FAN**LEVELS times smaller.

Places within a source come from a sort by range over the cluster: every partition numbers its own rows, and the
numbers of rows that a source has in earlier partitions are added, so no task holds a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm import _store

FAN = 16
#: Levels that a block collapses: it holds up to FAN**LEVELS nodes.
LEVELS = 2
#: Rows of a partition of the sort.
SORTED_ROWS = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """The lower-case hex sha256 of strings put together."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields, each as its length in bytes, `:`, value; `-` for a null."""

    def told(field: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(field).cast("string"), F.lit(":"), field), F.lit("-"))

    return digest(*[told(f.cast("string")) for f in fields])


def _collapsed(nodes: Column) -> Column:
    """The next level: each run of FAN neighbouring nodes, the last one may be shorter, becomes its digest."""
    run = lambda i: F.slice(nodes, i * FAN + 1, F.lit(FAN))
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int")),
        lambda i: F.aggregate(run(i), F.lit(""), lambda a, x: F.concat(a, x), lambda a: F.sha2(a, 256)),
    )


def numbered(rows: DataFrame, group: str, order: Sequence[str], url: str, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """The rows with `idx`, the place in their group by `order` (nulls first), and `total`, the group's size.  A null group is one."""
    parts = int(rows.count() // sorted_rows + 1)
    rows = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id())
    rows = _store.save(rows, url).withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    of_group = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = rows.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    spans = spans.select(F.col(group).alias("_group"), F.col("part").alias("_part"), (before - F.col("first")).alias("shift"), F.sum("n").over(of_group).alias("total"))
    # a partition of the sort is bounded, so is a key of this join
    met = rows.join(spans, rows[group].eqNullSafe(spans["_group"]) & (rows["part"] == spans["_part"]))
    return met.withColumn("idx", F.col("at") + F.col("shift")).drop("_group", "_part", "part", "at", "shift")


@dataclass
class Tree:
    """The rounds of all groups' trees: tables of blocks (group, block, total, items, level0, level1, ...), each row with its root."""

    rounds: list[DataFrame]
    roots: DataFrame

    def steps(self, place: Column) -> Column:
        """What a block's node at `place` is put together with, level by level within the block: (left, right) siblings."""

        def step(k: int) -> Column:
            own = F.floor(place / FAN**k).cast("int")
            within = own % FAN
            level = F.col(f"level{k}")
            pair = F.struct(F.array_join(F.slice(level, own - within + 1, within), "").alias("left"), F.array_join(F.slice(level, own + 2, FAN - 1 - within), "").alias("right"))
            return F.when(F.col("total") > FAN**k, pair)

        return F.filter(F.array(*[step(k) for k in range(LEVELS)]), lambda s: s.isNotNull())

    def blocks_with_path(self, above: DataFrame | None = None) -> DataFrame:
        """The first round's blocks with `path`: the steps from a block's root to the root of all.

        `above` is (group, path, ...) of the groups' own roots; its other columns are added.
        """
        path: DataFrame | None = None
        for rows in reversed(self.rounds):
            table = rows.withColumn("path", F.array().cast(_STEPS))
            if path is not None:
                known = path.select(F.col("group").alias("_group"), F.col("idx").alias("_idx"), F.col("path").alias("_path"))
                table = table.join(known, table["group"].eqNullSafe(known["_group"]) & (table["block"] == known["_idx"]), "left")
                table = table.withColumn("path", F.coalesce("_path", "path")).drop("_group", "_idx", "_path")
            nodes = table.select("*", F.posexplode("level0").alias("place", "node"))
            path = nodes.select("group", (F.col("block") * FAN**LEVELS + F.col("place")).alias("idx"), F.concat(self.steps(F.col("place")), F.col("path")).alias("path"))
        if above is None:
            return table
        more = above.withColumnRenamed("path", "_above").withColumnRenamed("group", "_group")
        met = table.join(more, table["group"].eqNullSafe(more["_group"]))
        return met.withColumn("path", F.concat("path", "_above")).drop("_group", "_above")


def build(nodes: DataFrame, order: Sequence[str], carry: Sequence[str], folder: str, sorted_rows: int = SORTED_ROWS) -> Tree:
    """Trees over nodes (group, node, ...): of each group, by `order`; the first round's items carry columns along."""
    width, rounds, roots = FAN**LEVELS, [], None
    level = numbered(nodes, "group", order, f"{folder}/sorted", sorted_rows)
    while True:
        block = F.floor(F.col("idx") / width).alias("block")
        table = level.groupBy("group", block, "total").agg(F.array_sort(F.collect_list(F.struct("idx", "node", *carry))).alias("items"))
        table = table.withColumn("level0", F.transform("items", lambda x: x["node"]))
        for k in range(LEVELS):
            table = table.withColumn(f"level{k + 1}", F.when(F.col("total") > FAN**k, _collapsed(F.col(f"level{k}"))))
        top = F.coalesce(*[F.get(f"level{k}", F.lit(0)) for k in range(LEVELS, -1, -1)])
        table = _store.save(table.withColumn("root", top).drop(f"level{LEVELS}"), f"{folder}/round{len(rounds)}")
        rounds.append(table)
        done = table.filter(F.col("total") <= width).select("group", "root")
        roots = done if roots is None else roots.unionByName(done)
        if (table.agg(F.max("total")).first()[0] or 0) <= width:
            return Tree(rounds, _store.save(roots, f"{folder}/roots"))
        carry = []
        level = table.filter(F.col("total") > width).select("group", F.col("block").alias("idx"), F.col("root").alias("node"), F.ceil(F.col("total") / width).alias("total"))


def _folded(node: Column, path: Column) -> Column:
    return F.aggregate(path, node, lambda a, s: digest(s["left"], a, s["right"]))


def proofs(leaves: DataFrame, carry: Sequence[str] = (), sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """Blocks of a manifest over leaves (group, order..., node, carried columns): group, items, subroot, root, path and levels.

    Leaves must have the columns `group`, `key` (what they are sorted by in their group) and `node`; equal keys go
    by node.  `subroot` is the group's root, `root` that of all groups' roots by group, nulls first.
    """
    folder = _store.new_folder(leaves.sparkSession, "merkle")
    tree = build(leaves, ["key", "node"], carry, f"{folder}/groups", sorted_rows)
    tops = tree.roots.select(F.lit(0).alias("group"), F.col("group").alias("key"), F.col("root").alias("node"))
    over = build(tops, ["key"], ["key"], f"{folder}/all", sorted_rows)
    blocks = over.blocks_with_path(over.roots.select("group", "root", F.array().cast(_STEPS).alias("path")).withColumnRenamed("root", "_root"))
    item = F.transform("items", lambda x, i: F.struct(x["key"].alias("group"), x["node"].alias("subroot"), F.concat(over.steps(i), F.col("path")).alias("path")))
    above = blocks.select(F.col("_root").alias("whole"), F.explode(item).alias("x")).select("x.group", "x.subroot", "x.path", "whole")
    above = _store.light(_store.save(above, f"{folder}/above"))
    found = tree.blocks_with_path(above).withColumn("root", F.col("whole")).drop("whole")
    return found.withColumn("proof", F.transform("items", lambda x, i: F.struct(x.alias("item"), F.concat(tree.steps(i), F.col("path")).alias("path"))))


def manifest(documents: DataFrame, fields: Sequence[str] = FIELDS, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """Per document: doc_id, source, leaf, subroot, root, and `path`, the siblings on either side from the leaf up.

    Leaves of a source go by doc_id, nulls first, equal ids by leaf; a null source is a source of its own, the first.
    Every row is a leaf, also a repeated one.  Null fields count as `-`, empty texts as `0:`.  An empty table gives
    no rows.
    """
    rows = documents.select(F.col("source").alias("group"), F.col("doc_id").alias("key"), leaf(*[documents[f] for f in fields]).alias("node"))
    rows = _store.save(rows, f"{_store.new_folder(documents.sparkSession, 'leaves')}/leaves")
    found = proofs(rows, ["key"], sorted_rows).select(F.col("group").alias("source"), "subroot", "root", F.explode("proof").alias("p"))
    return found.select(F.col("p.item.key").alias("doc_id"), "source", F.col("p.item.node").alias("leaf"), "subroot", "root", F.col("p.path").alias("path"))


def tampered(documents: DataFrame, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The manifest is of the rows as they are; then each row with 5 | crc32(doc_id) has its text lower-cased (A-Z) and
    is checked against the manifest by its leaf and the original siblings.  A row without doc_id is left alone.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    changed = [F.translate("text", upper, lower) if f == "text" else F.col(f) for f in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = documents.select(*FIELDS).select(F.col("source").alias("group"), F.col("doc_id").alias("key"), leaf(*[F.col(f) for f in FIELDS]).alias("node"), F.when(hit, leaf(*changed)).alias("found"))
    rows = _store.save(rows, f"{_store.new_folder(documents.sparkSession, 'leaves')}/leaves")

    def checked(p: Column) -> Column:
        siblings = F.aggregate(p["path"], F.lit(""), lambda a, s: F.concat(a, s["left"], s["right"]), lambda a: F.sha2(a, 256))
        return F.struct(p["item"]["key"].alias("doc_id"), p["item"]["node"].alias("leaf"), siblings.alias("proof_sha256"), _folded(F.coalesce(p["item"]["found"], p["item"]["node"]), p["path"]).alias("folded_root"))

    found = proofs(rows, ["key", "found"], sorted_rows)
    found = found.select("subroot", "root", F.explode(F.transform("proof", checked)).alias("x"))
    return found.select("x.doc_id", "x.leaf", "subroot", "root", "x.proof_sha256", "x.folded_root", (F.col("x.folded_root") == F.col("root")).alias("verified"))
