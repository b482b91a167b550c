"""Sharding by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards. A row descends from the root; at each level every child
draws -ln(u) / weight from a hash of the row's key and the child's name, and the smallest draw wins,
so a child is chosen in proportion to its weight. A child's draw does not depend on its siblings:
when a weight changes, only rows that enter or leave that child move, and movement stays within the
subtree above it. ``grow`` hangs one more shard under the root in a region of its own; rows move only
into it.

Slots are gapless from 0 in each shard: blocks of hash order are numbered in parallel and shifted by
the rows of the blocks before them, so that no shard has to meet in one task.

Law ``key``: the doc_id and the tree decide the shard, nothing else. The order of slots also depends on the
text, so that rows of one id, or without an id, are many blocks if their texts differ.

Defined cases: a null doc_id is a key of its own; null texts are empty; texts of any length are one row;
equal rows get slots in any order, which leaves the result the same; an empty table gives an empty table;
input columns that clash with an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, with_outputs

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]
OUTPUTS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def even_tree(shards: int = 8, racks: int = 2, per_rack: int = 2) -> Tree:
    """Shards of weight 1, per_rack to a rack and racks to a region."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return tree


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    new = 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards)
    return tree | {f"region-{new}": {f"rack-{new}": {new: weight}}}


def _draw(key: Column, name: str, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{name}"))), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 1) / float(1 << 48)) / weight


def _choice(key: Column, options: list[tuple[str, float, Column]]) -> Column:
    """The option with the smallest draw; options: name, weight, value."""
    if len(options) == 1:
        return options[0][2]
    draws = [F.struct(_draw(key, name, weight).alias("d"), F.lit(name).alias("n")) for name, weight, _ in options]
    won = F.array_min(F.array(*draws))["n"]
    out = F.when(won == options[0][0], options[0][2])
    for name, _, value in options[1:-1]:
        out = out.when(won == name, value)
    return out.otherwise(options[-1][2])


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key."""
    regions = []
    for region, racks in tree.items():
        inner = []
        for rack, shards in racks.items():
            leaf = _choice(key, [(f"shard{s}", w, F.lit(s)) for s, w in shards.items()])
            inner.append((rack, sum(shards.values()), leaf))
        regions.append((region, sum(w for _, w, _ in inner), _choice(key, inner)))
    return _choice(key, regions)


def shard(docs: DataFrame, tree: Tree | None = None, text: str = "text", doc_id: str = "doc_id", block_rows: int = 4000, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default) with size, text_crc32, law, shard, slot and grown_shard."""
    tree = tree or even_tree()
    t = F.coalesce(F.col(text), F.lit(""))
    key = F.when(F.col(doc_id).isNull(), "null").otherwise(F.concat(F.lit("id/"), F.col(doc_id).cast("string")))
    carry = docs.columns if carry is None else carry
    df = docs.select(
        F.struct(*carry).alias("_row"), key.alias("_key"), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t).alias("text_crc32"), F.md5(t).alias("_text"),
    ).select("*", F.md5(F.concat_ws("/", "_key", "_text")).alias("_hash"), place(F.col("_key"), tree).alias("shard"), place(F.col("_key"), grow(tree)).alias("grown_shard"))
    shards = max(1, sum(len(s) for racks in tree.values() for s in racks.values()))
    rows, digits = docs.count(), 0
    while rows > shards * block_rows * 16**digits:
        digits += 1
    df = df.withColumn("_block", F.substring("_hash", 1, digits))
    sizes = df.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = materialize(sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "slots")
    within = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_hash", "_key", "text_crc32", "size"))
    df = df.withColumn("_at", within).join(shifts, ["shard", "_block"])
    df = df.withColumn("slot", F.col("_shift") + F.col("_at") - 1).withColumn("law", F.lit("key"))
    return df.select(with_outputs("_row", carry, OUTPUTS))
