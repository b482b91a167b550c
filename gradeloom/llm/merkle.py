"""A Merkle manifest of a table: a root over all rows, and a proof for each.

Rows are leaves. The leaves of a tree (a language, say) ascend by an order, and each run of ``arity`` consecutive
nodes becomes its parent until one node, the subroot, remains; subroots of all trees are combined likewise to one root.

Places are dealt out by one range sort of digests: the texts are read once and never shuffled. Then children are
events. A task keeps, for each parent, the digests of the children it has met, by index. The level's size says how
many children a parent has; once they are all there, the parent is emitted and becomes an event for its own parent. A
batch of sorted leaves resolves all but a few nodes at its ends. Those, the frontier, are shuffled by stretches of
places, which widen from round to round, until only subroots are left: a frontier has some dozens of nodes for a
batch, and a task some thousands. Each node keeps a link to the highest ancestor that was found with it and the
siblings on the way; joined back from the last round to the first, the links give each leaf's whole proof.

Defined cases: nulls have an encoding of their own ("-"), a null order value comes first, a null tree first among
trees; an empty text is not a null; texts of any length are hashed whole; rows equal in order value ascend by their
digests, and wholly equal rows are leaves each; a table of one row has it as root; an empty table gives an empty
table; extra columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import join_uneven, materialize, with_outputs

#: Leaves below a group of the first frontier (two to this power) and how much wider the groups of the next are.
FIRST, WIDER = 22, 10
BATCH = 8192


def digest(columns: list[Column]) -> Column:
    """SHA-256 of values: "-" for a null, else its bytes in UTF-8, ":" and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _places(leaves: DataFrame) -> DataFrame:
    """leaves (_tree, _order, _leaf and more), written: each with its place in its tree, _at, and the tree's size, _size."""
    bound = leaves.withColumn("_tie", F.monotonically_increasing_id())
    dealt = bound.repartitionByRange("_tree", F.col("_order").asc_nulls_first(), "_leaf", "_tie").sortWithinPartitions("_tree", F.col("_order").asc_nulls_first(), "_leaf", "_tie")
    row = F.monotonically_increasing_id()
    # one writing deals out partition and row for good, whichever task is run again later
    ranked = materialize(dealt.drop("_tie").withColumn("_nth", row).withColumn("_part", F.shiftright("_nth", 33)).withColumn("_nth", F.col("_nth").bitwiseAND((1 << 33) - 1)), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition of the sort
    starts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    counted = ranked.join(F.broadcast(starts), "_part").withColumn("_all", F.col("_start") + F.col("_nth")).drop("_part", "_nth", "_start")
    trees = materialize(counted.groupBy("_tree").agg(F.min("_all").alias("_from"), F.count(F.lit(1)).alias("_size"), F.count(F.lit(1)).alias("_n")), "trees")
    return join_uneven(counted, trees, "_tree", "_n", leaves.count()).withColumn("_at", F.col("_all") - F.col("_from")).drop("_all", "_from")


def _resolve(nodes: list[tuple[str, int, int, int, str]], arity: int) -> list[tuple[int, int, str, str]]:
    """For each node (tree, size, level, index, digest): its highest ancestor found here (level, index, digest) and the siblings on the way."""
    known: dict[tuple, str] = {}
    partial: dict[tuple, dict[int, str]] = {}
    sizes: dict[tuple[str, int], list[int]] = {}
    for tree, size, _, _, _ in nodes:
        if (tree, 0) not in sizes:
            level = 0
            sizes[tree, 0] = size
            while size > 1:
                size, level = -(-size // arity), level + 1
                sizes[tree, level] = size
    for tree, _, level, index, hashed in nodes:
        while True:
            known[tree, level, index] = hashed
            size = sizes[tree, level]
            if size == 1:
                break
            parent = index // arity
            met = partial.setdefault((tree, level + 1, parent), {})
            met[index] = hashed
            if len(met) < min(arity, size - parent * arity):
                break
            hashed = sha256("".join(met[k] for k in sorted(met)).encode()).hexdigest()
            level, index = level + 1, parent
    links: dict[tuple, tuple[int, int, str, str]] = {}

    def climb(at: tuple) -> tuple[int, int, str, str]:
        way = []
        while at not in links:
            tree, level, index = at
            above = (tree, level + 1, index // arity)
            if above not in known:
                links[at] = (level, index, known[at], "")
                break
            met = partial[above]
            way.append((at, "".join(met[k] for k in sorted(met) if k != index)))
            at = above
        for below, siblings in reversed(way):
            level, index, top, path = links[at]
            at = below
            links[at] = (level, index, top, siblings + path)
        return links[at]

    return [climb((tree, level, index)) for tree, _, level, index, _ in nodes]


_LINK = "_top long, _top_at long, _top_digest string, _first boolean, _path binary"


def _linked(batch: pa.RecordBatch, arity: int) -> pa.RecordBatch:
    """Rows with _tree, _size, _level, _at and _leaf, and their links; _first marks one row of each top."""
    nodes = list(zip(*(batch.column(c).to_pylist() for c in ("_tree", "_size", "_level", "_at", "_leaf")), strict=True))
    found = _resolve(nodes, arity)
    told: set[tuple] = set()
    first = []
    for (tree, *_), (level, index, _, _) in zip(nodes, found, strict=True):
        first.append((tree, level, index) not in told)
        told.add((tree, level, index))
    links = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.string()), pa.array(first, pa.bool_()), pa.array([bytes.fromhex(f[3]) for f in found], pa.binary())]
    return pa.RecordBatch.from_arrays([*batch.columns, *links], [*batch.schema.names, "_top", "_top_at", "_top_digest", "_first", "_path"])


def _combine(placed: DataFrame, arity: int, first: int = FIRST, wider: int = WIDER, batch_rows: int = BATCH) -> DataFrame:
    """placed (_tree, _at, _size, _leaf and more) with _subroot and _path, the siblings up to it as bytes."""

    def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                yield _linked(batch.slice(at, batch_rows), arity)

    def by_group(table: pa.Table) -> pa.Table:
        batches = table.drop_columns("_stretch").combine_chunks().to_batches()
        return pa.Table.from_batches([_linked(b, arity) for b in batches])

    def schema(df: DataFrame) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", " + _LINK

    leaves = placed.withColumn("_level", F.lit(0).cast("long")).sortWithinPartitions("_tree", "_at")
    lowest = materialize(leaves.mapInArrow(by_batch, schema(leaves)), "links")
    largest = lowest.agg(F.max("_size")).first()[0] or 1
    rounds, width = [lowest], first
    while True:
        frontier = rounds[-1].where("_first").select("_tree", "_size", F.col("_top").alias("_level"), F.col("_top_at").alias("_at"), F.col("_top_digest").alias("_leaf"))
        begins = F.col("_at") * F.pow(F.lit(float(arity)), F.col("_level"))
        groups = frontier.withColumn("_stretch", F.floor(begins / float(1 << width))).groupBy("_tree", "_stretch")
        rounds.append(materialize(groups.applyInArrow(by_group, schema(frontier)), "links"))
        if 1 << width >= largest:
            break
        width += wider
    upper = rounds.pop().select("_tree", "_level", "_at", F.col("_top_digest").alias("_subroot"), F.col("_path").alias("_way"))
    while True:  # back from the subroots: a node's siblings are its own way's and its top's
        nodes = rounds.pop()
        tops = upper.select(F.col("_tree").alias("_of"), F.col("_level").alias("_of_level"), F.col("_at").alias("_of_at"), "_subroot", "_way")
        joined = nodes.join(tops, (F.col("_tree") == F.col("_of")) & (F.col("_top") == F.col("_of_level")) & (F.col("_top_at") == F.col("_of_at")))
        path = F.concat("_path", "_way")
        if not rounds:
            return joined.select(*placed.columns, "_subroot", path.alias("_path"))
        upper = joined.select("_tree", "_level", "_at", "_subroot", path.alias("_way"))


def fold(leaf: Column, path: Column, at: Column, size: Column, arity: int = 2) -> Column:
    """The root that a leaf at this place of a tree of this size leads to by its siblings (bytes, bottom up, left to right)."""
    powers = [arity**k for k in range(63) if arity**k < 1 << 62]
    levels = sum(((size > p).cast("int") for p in powers[1:]), (size > 1).cast("int"))

    def up(state: Column, _: Column) -> Column:
        begin = state["index"] - state["index"] % arity
        others = F.least(F.lit(arity).cast("long"), state["size"] - begin) - 1
        siblings = F.lower(F.hex(F.substr(path, (state["used"] * 32 + 1).cast("int"), (others * 32).cast("int"))))
        own = ((state["index"] - begin) * 64).cast("int")
        whole = F.concat(F.substr(siblings, F.lit(1), own), state["digest"], F.substr(siblings, own + 1))
        return F.struct(
            F.sha2(whole, 256).alias("digest"), F.floor(state["index"] / arity).cast("long").alias("index"), F.ceil(state["size"] / arity).cast("long").alias("size"), (state["used"] + others).alias("used"),
        )

    begin = F.struct(leaf.alias("digest"), at.cast("long").alias("index"), size.cast("long").alias("size"), F.lit(0).cast("long").alias("used"))
    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, begin, up)["digest"]


def manifest(rows: DataFrame, columns: list[str], tree: str, order: str, arity: int = 2, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (order by default), leaf, subroot, root, place (at, size, tree_at, trees) and the proof: path within the tree and top_path from there to the root."""
    carry = [order] if carry is None else carry
    own = F.when(F.col(tree).isNull(), "").otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))
    leaves = materialize(rows.select(F.struct(*carry).alias("_row"), own.alias("_tree"), F.col(order).alias("_order"), digest([F.col(c) for c in columns]).alias("_leaf")), "leaves")
    within = materialize(_combine(_places(leaves), arity).drop("_order"), "trees")
    trees = within.where("_at = 0").select(F.lit("").alias("_tree"), F.col("_tree").alias("_order"), F.col("_subroot").alias("_leaf"), F.col("_tree").alias("_key"), F.col("_size").alias("_n"))
    above = materialize(_combine(_places(materialize(trees, "subroots")), arity).select(
        F.col("_key").alias("_tree"), "_n", F.col("_subroot").alias("root"), F.col("_at").alias("tree_at"), F.col("_size").alias("trees"), F.col("_path").alias("top_path")), "roots")
    done = join_uneven(within, above, "_tree", "_n", leaves.count())
    outputs = ["leaf", "subroot", "root", "at", "size", "tree_at", "trees", "path", "top_path"]
    named = done.select("_row", F.col("_leaf").alias("leaf"), F.col("_subroot").alias("subroot"), "root", F.col("_at").alias("at"), F.col("_size").alias("size"), "tree_at", "trees", F.col("_path").alias("path"), "top_path")
    return named.select(with_outputs("_row", carry, outputs))


def proof_digest() -> Column:
    """SHA-256 of a manifest row's siblings, bottom up and left to right."""
    return F.sha2(F.lower(F.hex(F.concat("path", "top_path"))), 256)


def folded(leaf: Column, arity: int = 2) -> Column:
    """The root that a leaf leads to from a manifest row's place by its siblings."""
    return fold(fold(leaf, F.col("path"), F.col("at"), F.col("size"), arity), F.col("top_path"), F.col("tree_at"), F.col("trees"), arity)
